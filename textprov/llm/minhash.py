"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

Signature. In SuperMinHash each element takes the ranks 0..M-1 of one permutation of the M slots, so
that slots are negatively correlated and the estimate varies less than with independent hashes; the
value in the slot of rank j is j plus a fraction. M is prime and the permutation of an element is
``(a + j * b) mod M`` with ``a`` and ``b`` from its hash: over elements, the ranks in any two slots are
uniform on all pairs of different ranks, which is all that the variance depends on. Rank j is worked
off for all texts of a block at once; a text stops as soon as every slot holds a lower rank.

Candidates. BANDS bands of ROWS slots: a pair at the threshold of 0.7 is missed by all bands once in
57,000 times, likelier pairs less often. Texts with equal sets are one class from the start. Before
whole sets are moved, pairs are dropped whose sizes rule out a link, or whose counts by hash range (a
byte a shingle instead of eight) do: the sum of the smaller counts is never below the intersection.

Verification loses no pair of a bucket, however large: each round takes hubs (one a bucket, then 8, 64, ...
by salted minimum), compares the whole sets of every member with its bucket's hubs unless they are in one
component already, joins what is linked, and drops the hubs. A bucket is done when its members are in one
component. So a bucket of linked texts takes as many comparisons as it has members, and one of texts that
are alike by chance or by a passage and aren't linked ends with all its pairs looked at, by sizes and counts
first. Bucket joins are on the bucket with AQE's splitting of skewed partitions; hubs are few.

Sets are sets of 64-bit hashes of lower-cased word windows; classes have 128-bit digests.

Defined results: null and empty texts (no words) have an empty set and are linked with nothing; a text
of fewer words than a window is one shingle; null ids never are a component's id, and a group of null
ids alone has a null component; rows repeated with one id are all kept or all dropped; null-id rows
are kept only where their group has no id at all. Empty tables give empty results; other columns
aren't read by ``near_duplicates`` and are passed on by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textscan
from .components import connected

M, BANDS, ROWS = 163, 40, 4
WINDOW, PERCENT = 5, 70
#: More hubs a bucket from round to round.
HUBS = 8

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEED = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the text of each."""
    words = textscan.Words(data, offsets, lower=True)
    h = words.hashes()
    found, at = textscan.windows(h, words.text, window)
    hashes, texts = [found], [words.text[at]]
    size = words.counts[words.text]
    for n in range(1, window):
        mine = size == n
        if mine.any():
            one, at = textscan.windows(h[mine], words.text[mine], n)
            hashes.append(one)
            texts.append(words.text[mine][at])
    unique, text, _ = textscan.distinct_in_texts(np.concatenate(hashes), np.concatenate(texts))
    return unique, text


def superminhash(h: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Signatures (n_texts, M); EMPTY where a text has no element."""
    sig = np.full(n_texts * M, EMPTY, np.uint64)
    slot = (h % np.uint64(M)).astype(np.int64)
    step = (1 + (h >> np.uint64(32)) % np.uint64(M - 1)).astype(np.int64)
    for rank in range(M):
        fraction = textscan.mix(h + np.uint64((rank + 1) * int(_SEED) % 2**64)) >> np.uint64(8)
        np.minimum.at(sig, text * M + slot, fraction | np.uint64(rank << 56))
        open_texts = (sig.reshape(n_texts, M) == EMPTY).any(axis=1)
        live = open_texts[text]
        if not live.any():
            break
        if not live.all():
            h, text, slot, step = h[live], text[live], slot[live], step[live]
        slot = slot + step
        slot[slot >= M] -= M
    return sig.reshape(n_texts, M)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) bucket keys; different bands have different keys."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = textscan.mix(key * _SEED + sig[:, b * rows + r])
        out[:, b] = key
    return out


def _digests(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """16 bytes for each set, null for an empty one: sums of two hashes of its elements."""
    n = len(first) - 1
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some, 0] = np.add.reduceat(textscan.mix(h ^ _SEED), first[some])
        out[some, 1] = np.add.reduceat(textscan.mix(h + _SEED), first[some])
    raw = out.tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if first[i + 1] > first[i] else None for i in range(n)], pa.binary())


def signatures(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """file, row, doc_id, n_shingles, digest of the set and its band keys of ``docs`` (file, row, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64())
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                h, text = shingles(data, offsets, window)
                n = hi - lo
                first = np.searchsorted(text, np.arange(n + 1))
                keys = band_keys(superminhash(h, text, n)).view(np.int64)
                size = np.diff(first)
                bands = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(np.where(size > 0, BANDS, 0))).astype(np.int32)), pa.array(keys[size > 0].ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [batch["file"].slice(lo, n), batch["row"].slice(lo, n), ids.slice(lo, n), pa.array(size.astype(np.int64)), _digests(h, first), bands],
                    names=["file", "row", "doc_id", "n_shingles", "digest", "bands"],
                )

    schema = "file long, row long, doc_id long, n_shingles long, digest binary, bands array<long>"
    return docs.select("file", "row", "doc_id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, folder: str, window: int) -> DataFrame:
    """cid, size and set (sorted 64-bit hashes, as bytes) of the rows of ``docs`` (file, row, text) that ``folder`` has a cid for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.Decisions(folder, -1)
        for batch in batches:
            cid = wanted.look(batch["file"].to_numpy(), batch["row"].to_numpy())
            texts, cid = batch["text"].filter(pa.array(cid >= 0)), cid[cid >= 0]
            for lo, hi, data, offsets in textscan.blocks(texts):
                h, text = shingles(data, offsets, window)
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                columns = [pa.array(cid[lo:hi]), pa.array(np.diff(first).astype(np.int64)), _binary(h.tobytes(), 8 * first), _binary(*ranges(h, text, first))]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "size", "elements", "ranges"])

    return docs.select("file", "row", "text").mapInArrow(run, "cid long, size long, elements binary, ranges binary")


def _binary(raw: bytes, offsets: np.ndarray) -> pa.Array:
    parts = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, parts).cast(pa.binary())


def ranges(h: np.ndarray, text: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Counts of a set's hashes in 2^k equal ranges, 2^k being its size or the next power; none where a count is over 255."""
    size = np.diff(first)
    k = np.maximum(np.frexp(np.maximum(size, 2) - 1.0)[1], 4)
    begin = np.append(0, np.cumsum(np.where(size > 0, 1 << k, 0)))
    counts = np.bincount(begin[text] + (h >> (64 - k[text]).astype(np.uint64)).astype(np.int64), minlength=begin[-1])
    if counts.max(initial=0) > 255:
        over = np.zeros(len(size), bool)
        over[np.searchsorted(begin, np.flatnonzero(counts > 255), "right") - 1] = True
        counts = counts[np.repeat(~over, np.diff(begin))]
        begin = np.append(0, np.cumsum(np.where(over, 0, np.diff(begin))))
    return counts.astype(np.uint8).tobytes(), begin


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose counts by range don't rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(len(batch), bool)
            for i, (x, y, m, n) in enumerate(zip(batch["x"], batch["y"], batch["m"].to_pylist(), batch["n"].to_pylist())):
                p, q = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                if not len(p) or not len(q):
                    continue
                if len(p) > len(q):
                    p, q = q, p
                if len(p) < len(q):
                    q = q.reshape(len(p), -1).sum(axis=1, dtype=np.int64)
                most = int(np.minimum(p, q).sum(dtype=np.int64))
                stays[i] = 100 * most >= percent * (m + n - most)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(stays))

    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("ranges").alias("x"), F.col("size").alias("m")), "a")
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("ranges").alias("y"), F.col("size").alias("n")), "b")
    return both.select("a", "b", "x", "y", "m", "n").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked: 100 * intersection >= percent * union, on whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                linked[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked)], names=["a", "b", "linked"])

    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("x")), "a")
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _components(docs: DataFrame, classes: DataFrame, window: int, percent: int) -> DataFrame:
    """cid and comp (smallest cid linked with it) of classes that are linked with others."""
    # one exchange serves both sides; a class has BANDS different keys, so no key holds over 1/BANDS of these rows
    keyed = classes.select("cid", "size", F.explode("bands").alias("key")).repartition(shared.parts(docs.sparkSession), "key")
    hub = F.min(F.struct("cid", "size")).alias("hub")
    shared_keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), hub).filter("n > 1").drop("n")
    members = shared.written(keyed.join(shared_keys, "key"), "buckets")

    def near_size(x, y):
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    pairs = members.filter((F.col("cid") != F.col("hub.cid")) & near_size(F.col("size"), F.col("hub.size")))
    pairs = shared.written(pairs.select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    # the sets of the classes that share a bucket with another, from the one text that stands for each
    needed = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    folder = shared.save_decisions(needed.select("rep.file", "rep.row", F.col("cid").alias("value")), "needed")
    sets = shared.written(_sets(docs, folder, window), "sets")
    members, links, tried, comps = members.drop("hub"), None, None, None
    hubs = members.groupBy("key").agg(F.min("cid").alias("cid"))
    rounds = 0
    while True:
        near = shared.written(_plausible(pairs, sets, percent), "plausible")
        linked = shared.written(_verified(near, sets, percent), "verified").filter("linked").select("a", "b")
        links = linked if links is None else links.unionByName(linked)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not linked.isEmpty() or comps is None:
            comps = connected(links)
        # the hubs of this round have met every member of their bucket
        members = members.join(hubs, ["key", "cid"], "left_anti")
        labelled = members.join(comps.select("cid", "comp"), "cid", "left").select("key", "cid", "size", F.coalesce("comp", "cid").alias("comp"))
        labelled = shared.written(labelled, "members")
        open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        members = shared.written(labelled.join(open_keys, "key", "left_semi"), "open")
        if members.isEmpty():
            return comps
        rounds += 1
        salt = F.pmod(F.xxhash64("cid", F.lit(rounds)), F.lit(HUBS**rounds))
        hub = F.min(F.struct("cid", "comp", "size")).alias("hub")
        hubs = shared.written(members.groupBy("key", salt.alias("salt")).agg(hub).drop("salt"), "hubs")
        met = members.join(hubs, "key").filter((F.col("comp") != F.col("hub.comp")) & near_size(F.col("size"), F.col("hub.size")))
        met = met.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct()
        pairs = shared.written(met.join(tried, ["a", "b"], "left_anti"), "pairs")
        members, hubs = members.drop("comp"), hubs.select("key", "hub.cid")


def near_duplicates(docs: DataFrame, window: int = WINDOW, percent: int = PERCENT, placed: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; file and row too if ``placed`` (``docs`` has them then)."""
    shared.small_batches(docs.sparkSession)
    if not placed:
        docs, file, row = shared.located(docs)
        docs = docs.select("doc_id", "text", file.alias("file"), row.alias("row"))
    rows = shared.written(signatures(docs, window), "signatures")
    # a class stands for all texts of one set; its bands and place are those of one of them
    classes = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_rows"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"),
        F.min(F.struct("file", "row")).alias("rep"),
    )
    with shared.scratch() as stays:
        classes = shared.written(classes, "classes")
        classes = shared.written(classes.withColumn("cid", F.monotonically_increasing_id()), "numbered")
        comps = _components(docs, classes, window, percent)
        known = classes.select("cid", "digest", "rep_id", "n_rows")
        in_comp = shared.written(known.join(comps, "cid", "left"), "labelled")
        lowest = in_comp.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("rep_id").alias("of_comp"))
        both = in_comp.filter("comp IS NOT NULL OR n_rows > 1").join(lowest, "comp", "left")
        groups = both.select("digest", "n_rows", F.when(F.col("comp").isNull(), F.col("rep_id")).otherwise(F.col("of_comp")).alias("lowest"))
        groups = shared.written(groups, "groups")
        stays.append(groups)
    out = shared.join_groups(rows.drop("bands"), groups, "digest", "n_rows")
    component = F.when(F.col("n_rows").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    out = out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", "kept", *(("file", "row") if placed else ()))


def keep(docs: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is its component's, all columns; decisions are applied where rows are read, so no text is shuffled."""
    docs, file, row = shared.located(docs)
    with shared.scratch() as stays:
        rows = docs.select("doc_id", "text", file.alias("file"), row.alias("row"))
        out = near_duplicates(rows, window, percent, placed=True).filter("NOT kept")
        folder = shared.save_decisions(out.select("file", "row", F.lit(0).alias("value")), "near")
        stays.append(folder)
    return shared.kept(docs, file, row, folder)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS t FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(t[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - {WINDOW - 1}, 1) + 1)) AS i FROM w WHERE len(t) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.y FROM reach JOIN edges ON reach.b = edges.x),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM found LEFT JOIN sizes USING (doc_id)
"""
