"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counting. Documents are cut into runs of about RUN bytes of text. A run hashes its n-grams once and sends
the distinct ones, as gaps of sorted 48-bit keys in blobs, with the counts of those in training texts, to
the part of the key space that the hash's high bits name; each part adds up the counts. A hot n-gram is one
key a run, so parts are alike in size; there are as many as ``spark.sql.shuffle.partitions``, or one for
each PART bytes of documents if that is more.

Filter. A count c is quantised to level ``1 + floor(log_BASE c)``; an n-gram enters the filter once for
each level up to its own, and a look-up probes levels until one is missing. Each part builds its own
segment of BITS bits an item, so the filter grows with what was counted. It is neither broadcast nor
gathered: what a run sent is its question too, and the parts' levels go back through the shared folder to
the task that scores the run. N-grams of every count enter, those seen once at level 1.

Documents are read twice, once to count and ask and once to score; where they are no scan of files they are
written first, and a run that doesn't match its answer raises an error.

Score. Interpolation from order to order, ``p_n = w_n * c(ngram) / c(context) + (1 - w_n) * p_(n-1)``
where the context was seen and p_(n-1) elsewhere, above ``p_1 = (c + 1) / (N + V + 1)``, with
each level's mean count and no n-gram above its context: but for quantisation and false positives, a
probability whose sum over what may follow is 1. The base score uses exact counts of words by 64-bit hash. They take
the same way as levels: what a run sent names its words too, and their counts come back with the answer.

Defined results: null and empty texts are one end token; a null id is in the training part; repeated
rows count and are scored each; with no training text every token is unknown and N = V = 0; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import shared, textscan
from .shared import place

ORDER, BASE, BITS, PROBES = 3, 1.5, 10, 7
#: Weight of the counts of each order from 2 on.
WEIGHTS = (0.1, 0.3)
#: Words or n-grams that a part takes up before it merges them.
FLUSH = 3_000_000
#: Entries in a row of the table of counts.
CHUNK = 1 << 18
#: Bytes of text, and one a row, of the documents that ask and are scored at once.
RUN = 8 << 20
#: Bytes of documents for each part of the key space, at most.
PART = 16 << 20

END = np.uint64(0xA0761D6478BD642F)
_P, _G = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x9E3779B97F4A7C15)
_LOW, _S16, _S32 = np.uint64((1 << 32) - 1), np.uint64(16), np.uint64(32)


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, an end behind each text, and the text of each."""
    words = textscan.Words(data, offsets, lower=True)
    h = np.insert(words.hashes(), words.first[1:], END)
    return h, np.repeat(np.arange(len(offsets) - 1), words.counts + 1)


def grams(h: np.ndarray, text: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order from 2 the hash of the n-gram that ends at each token; 0 where the text has too few before it."""
    out, last = [], h
    for n in range(2, order + 1):
        now = np.zeros(len(h), np.uint64)
        if len(h) >= n:
            now[n - 1 :] = textscan.mix(last[: len(h) - n + 1] * _P + h[n - 1 :] + np.uint64(n))
            now[n - 1 :][text[n - 1 :] != text[: len(h) - n + 1]] = 0
        # the n-gram that ends one token earlier is the context of the next order
        out.append(now)
        last = now[n - 1 :] if len(h) >= n else now
    return out


def pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as gaps: three low bytes of each as they are, the higher ones compressed."""
    gaps = np.diff(keys, prepend=keys[:1])
    width = 4 if gaps.max(initial=0) >> _S32 == 0 else 6
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = np.array([keys[0] if len(keys) else 0, len(keys), width], "<u8").tobytes()
    return head + planes[:3].tobytes() + pa.compress(planes[3:].tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    first, n, width = np.frombuffer(raw, "<u8", 3).tolist()
    high = pa.decompress(raw[24 + 3 * n :], n * (width - 3), codec="zstd", asbytes=True)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :3] = np.frombuffer(raw, np.uint8, 3 * n, 24).reshape(3, n).T
    gaps[:, 3:width] = np.frombuffer(high, np.uint8).reshape(width - 3, n).T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(first)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts of 48-bit keys, ascending with the key."""
    return ((keys >> _S16) * np.uint64(parts) >> _S32).astype(np.int64)


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def runs(batches: Iterator[pa.RecordBatch], size: int = RUN) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches with about ``size`` bytes of text in all; the cuts don't depend on the batches."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo, before = 0, 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(ends, before + size - n)) + 1
            if hi > batch.num_rows:
                held.append(batch.slice(lo))
                n += int(ends[-1]) - before
                break
            yield [*held, batch.slice(lo, hi - lo)]
            held, n, lo, before = [], 0, hi, int(ends[hi - 1])
    if held:
        yield held


def read(run: list[pa.RecordBatch], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Token hashes, the text of each, and for each order from 2 the n-grams that end there."""
    found = []
    for lo, _, data, offsets in textscan.blocks(pa.chunked_array([b["text"] for b in run])):
        h, text = sequences(data, offsets)
        found.append((h, text + lo, *grams(h, text, order)))
    h, text, *longer = (np.concatenate(x) for x in zip(*found))
    return h, text, longer


def _check(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(textscan.mix(keys + _P)).view(np.int64))


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte a count, and those from 255 on behind them."""
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    raw = pa.CompressedInputStream(pa.BufferReader(raw), "zstd").read()
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return counts


def pack_words(words: np.ndarray, keys: np.ndarray) -> bytes:
    """Sorted distinct words whose high 48 bits are all among ``keys``: how many words each key has, and their low bits."""
    each = np.bincount(np.searchsorted(keys, words >> _S16), minlength=len(keys))
    return pa.compress(each.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), codec="zstd", asbytes=True) + words.astype("<u2").tobytes()


def unpack_words(raw: bytes, keys: np.ndarray, n: int) -> np.ndarray:
    each = np.frombuffer(pa.decompress(raw[: len(raw) - 2 * n], 2 * len(keys), codec="zstd", asbytes=True), np.uint8).reshape(2, -1)
    low = np.frombuffer(raw, "<u2", n, len(raw) - 2 * n).astype(np.uint64)
    return np.repeat(keys, each[0] + (each[1].astype(np.int64) << 8)) << _S16 | low


def tally(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit keys, sorted, and how often each comes with a flag."""
    both, n = np.unique(keys << np.uint64(1) | flags.astype(np.uint64), return_counts=True)
    n[both & np.uint64(1) == 0] = 0
    both >>= np.uint64(1)
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.empty(0, np.int64)
    return both[at], np.add.reduceat(n, at) if len(at) else n


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once; ``np.unique`` would hash them, which takes longer here."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and the place of each value of ``x`` among them; values are 64-bit hashes.

    ``np.unique`` does the same by argsort, which takes eight times as long as the sort of high bits and positions here.
    """
    low = np.uint64((1 << max(len(x) - 1, 1).bit_length()) - 1)
    order = (np.sort(x & ~low | np.arange(len(x), dtype=np.uint64)) & low).view(np.int64)
    found = x[order]
    # values whose high bits are the same came by position
    mixed = distinct(found[1:][found[1:] < found[:-1]] & ~low)
    if len(mixed) > 1000:
        order = np.argsort(x)
        found = x[order]
    elif len(mixed):
        high = found & ~low
        for lo, hi in zip(np.searchsorted(high, mixed), np.searchsorted(high, mixed, "right")):
            order[lo:hi] = order[lo:hi][np.argsort(found[lo:hi])]
            found[lo:hi] = x[order[lo:hi]]
    new = np.append(True, found[1:] != found[:-1])[: len(x)]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return found[new], place


SENT = "part int, task int, run int, check long, keys binary, counts binary, n_words int, words binary, times binary"
KEPT = "run int, part int, check long, sums binary, levels binary, times binary, task int"
#: Task of rows that answer no task: sums of counts by level.
OF_LEVELS = -1


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows), types)], names=names)


def answers(asking: list[DataFrame], order: int = ORDER, parts: int | None = None) -> tuple[DataFrame, str]:
    """A table (KEPT) and its folder: sums of counts by level, and for each run of the texts that ask the levels of its n-grams
    and the exact counts of its words.

    ``asking``: rows of text, ask and train (boolean, one ``ask`` a table). A run sends its distinct keys once, with the counts
    of those that come in training texts, and so its words; its levels and its words' counts, by part, are in their order.
    """
    spark = asking[0].sparkSession
    parts = parts or shared.parts(spark)

    def bounds(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(_part(keys, parts), np.arange(parts + 1))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, run in enumerate(runs(batches)):
            h, text, longer = read(run, order)
            train = np.concatenate([b["train"].to_numpy(zero_copy_only=False) for b in run])[text]
            asks = bool(run[0]["ask"][0].as_py())
            keys, flags = [h >> _S16], [train]
            for g in longer:
                there = g != 0
                keys.append(g[there] >> _S16)
                flags.append(train[there])
            keys, counts = tally(np.concatenate(keys), np.concatenate(flags))
            words = distinct(h)
            times = np.zeros(len(words), np.int64)
            k, n = np.unique(h[train], return_counts=True)
            times[np.searchsorted(words, k)] = n
            check, cut, word_cut = _check(keys), bounds(keys), bounds(words >> _S16)
            rows = []
            for p in np.flatnonzero(np.diff(cut)).tolist():
                k, c = keys[cut[p] : cut[p + 1]], counts[cut[p] : cut[p + 1]]
                w, n = words[word_cut[p] : word_cut[p + 1]], times[word_cut[p] : word_cut[p + 1]]
                rows.append((p, task if asks else -1, i, check, pack(k), pack_counts(c) if c.any() else None, len(w), pack_words(w, k), pack_counts(n) if n.any() else None))
            yield _rows(rows, SENT)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, part = [], None
        held, size = [np.empty(0, np.uint64)], 0
        word, n_words = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
        for batch in batches:
            for p, *row, words, times in zip(*(batch.column(i) for i in range(9))):
                part, words, times = p.as_py(), words.as_py(), times.as_py()
                task, run, check, raw, counts, n = (x.as_py() for x in row)
                k = unpack(raw)
                w = unpack_words(words, k, n)
                sent.append((task, run, check, raw, counts, w))
                held.append(k)
                size += len(k)
                if size > 2 * len(held[0]) + FLUSH:
                    held = [distinct(np.concatenate(held))]
                    size = len(held[0])
                if times is not None:
                    times = unpack_counts(times, n)
                    word.append((w[times > 0], times[times > 0]))
                    n_words += len(word[-1][0])
                    if n_words > 2 * len(word[0][0]) + FLUSH:
                        word = [_merge(*(np.concatenate(x) for x in zip(*word)))]
                        n_words = len(word[0][0])
        if part is None:
            return
        words, times = _merge(*(np.concatenate(x) for x in zip(*word)))
        keys = distinct(np.concatenate(held))
        del held, word
        counts = np.zeros(len(keys), np.int64)
        for i, (task, run, check, raw, c, w) in enumerate(sent):
            at = None
            if task >= 0 or c is not None:
                k = unpack(raw)
                at = np.searchsorted(keys, k).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
                if c is not None:
                    counts[at] += unpack_counts(c, len(k))
            sent[i] = (task, run, check, at, w) if task >= 0 else None
        top = np.zeros(len(keys), np.int64)
        there = counts > 0
        top[there] = levels(counts[there])
        sums = np.zeros((2, LEVELS + 1), np.int64)
        np.add.at(sums[0], top[there], counts[there])
        np.add.at(sums[1], top[there], 1)
        yield _rows([(0, part, 0, np.append(sums, [times.sum(), len(words)]).astype("<i8").tobytes(), None, None, OF_LEVELS)], KEPT)
        segment = Filter.build(keys[there], counts[there])
        del counts, there
        found = segment.level(keys, top).astype(np.uint8)
        words, times = np.append(words, np.uint64(0)), np.append(times, 0)  # so that a place behind the last word holds something
        for task, run, check, at, w in filter(None, sent):
            place = np.searchsorted(words[:-1], w)
            exact = np.where(words[place] == w, times[place], 0)
            yield _rows([(run, part, check, None, pa.compress(found[at].tobytes(), codec="zstd", asbytes=True), pack_counts(exact), task)], KEPT)

    # the tables that ask come first, so that tasks have the numbers that they have when documents are scored
    out = reduce(DataFrame.union, [x.mapInArrow(send, SENT) for x in asking])
    out = out.repartitionById(parts, "part").mapInArrow(answer, KEPT)
    folder = shared.new_folder(spark, "answers")
    to = F.when(F.col("task") < 0, F.col("part")).otherwise(F.col("task") % parts)
    out.repartitionById(parts, to).write.partitionBy("task").parquet(folder)
    return spark.read.schema(KEPT).parquet(folder), folder


class Answers:
    """The answers to the questions of one task."""

    def __init__(self, folder: str, task: int):
        fs, at = place(folder)
        self.raw: dict[int, list] = {}
        for file in fs.get_file_info(pafs.FileSelector(f"{at}/task={task}", allow_not_found=True)):
            if file.path.endswith(".parquet"):
                with fs.open_input_file(file.path) as f:
                    rows = pq.ParquetFile(f).read(columns=["run", "part", "check", "levels", "times"])
                for run, *rest in zip(*(c.to_pylist() for c in rows.columns)):
                    self.raw.setdefault(run, []).append(rest)

    def of(self, run: int, keys: np.ndarray, words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Levels of the sorted distinct ``keys`` of a run, and the counts of its sorted distinct ``words``."""
        check, sizes = _check(keys), np.bincount(_part(keys, parts), minlength=parts)
        n_words = np.bincount(_part(words >> _S16, parts), minlength=parts)
        found = {part: raw for part, seen, *raw in self.raw.pop(run, []) if seen == check}
        if sorted(found) != np.flatnonzero(sizes).tolist():
            raise ValueError("documents came in another order when they were read again")
        level = [np.frombuffer(pa.decompress(found[i][0], int(sizes[i]), codec="zstd", asbytes=True), np.uint8) for i in sorted(found)]
        return np.concatenate(level).astype(np.int64), np.concatenate([unpack_counts(found[i][1], int(n_words[i])) for i in sorted(found)])


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


LEVELS = 127


def totals(counted: DataFrame) -> tuple[np.ndarray, int, int]:
    """The mean count of each level (0 for level 0), so that counts sum to what was counted, the middle where a level is empty;
    the number of training tokens and of distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (LEVELS + 1) + 2, np.int64)
        for batch in batches:
            for raw in batch["sums"]:
                total += np.frombuffer(raw.as_buffer(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "n"])

    rows = counted.filter(F.col("task") == OF_LEVELS).select("sums").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    sums = np.zeros(2 * (LEVELS + 1) + 2, np.int64)
    for at, n in rows.collect():
        sums[at] = n
    total, items = sums[:-2].reshape(2, -1).astype(np.float64)
    middle = np.append(0.0, np.maximum(1.0, [(BASE ** (q - 1.0) + BASE**q - 1) / 2 for q in range(1, LEVELS + 1)]))
    return np.where(items > 0, total / np.maximum(items, 1), middle), int(sums[-2]), int(sums[-1])


def interpolate(level: np.ndarray, longer: list[np.ndarray], found: list[np.ndarray], means: np.ndarray, bottom: float, weights: tuple[float, ...]) -> np.ndarray:
    """The probability of each token. ``level``: of its word; ``found``: of the n-grams ``longer`` that end there, 0 where there is none.

    A context was counted as often as n-grams go on from it (a text's last token is its end, which nothing follows), so for
    each order the shares of all that follow a context sum to 1, and with those of the order below weighed in they still do.
    """
    p = (means[level] + 1) / bottom
    for g, its, w in zip(longer, found, weights):
        # an n-gram that was counted has a context and an ending that were
        before = np.append(0, level[:-1])
        before[g == 0] = 0
        level = np.where((before > 0) & (level > 0), np.minimum(its, before), 0)
        seen = np.flatnonzero(before)
        p[seen] = w * means[level[seen]] / means[before[seen]] + (1 - w) * p[seen]
    return p


class Filter:
    """A segment of ``bits`` bits. Keys: 48 bits of n-grams' hashes."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        """The segment of all ``keys``, BITS bits an item."""
        top = levels(counts)
        bits = max(64, -(-int(top.sum()) * BITS // 8) * 8)
        table = np.zeros(bits, bool)
        for level in range(1, int(top.max(initial=0)) + 1):
            mine = keys[top >= level]
            for i in range(0, len(mine), CHUNK):
                at, step = cls.places(mine[i : i + CHUNK], level, bits)
                for _ in range(PROBES):
                    table[at.view(np.int64)] = True
                    at += step
                    np.minimum(at, at - np.uint64(bits), out=at)  # below 0 it wraps, which is more
        return cls(bits, np.packbits(table, bitorder="little"))

    @staticmethod
    def places(key: np.ndarray, level: int | np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the item (key, level) that make its PROBES places within the segment."""
        x = textscan.mix(key * _P + np.atleast_1d(np.asarray(level, np.uint64)) * _G)
        # multiply-shift instead of a remainder
        return (x >> _S32) * np.uint64(bits) >> _S32, ((x & _LOW) * np.uint64(bits - 1) >> _S32) + np.uint64(1)

    def level(self, keys: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
        """Level of each n-gram; 0 if it isn't there. ``least``: levels up to which they are known to have entered."""
        out = np.zeros(len(keys), np.int64) if least is None else least.copy()
        bits = np.uint64(self.bits)
        for i in range(0, len(keys), CHUNK):
            here, now = keys[i : i + CHUNK], out[i : i + CHUNK]
            live = np.arange(len(here))
            while len(live):
                at, step = self.places(here[live], now[live] + 1, self.bits)
                for _ in range(PROBES):
                    hit = np.flatnonzero((self.table[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
                    live, at, step = live[hit], at[hit], step[hit]
                    at += step
                    np.minimum(at, at - bits, out=at)
                now[live] += 1
        return out


def score(docs: DataFrame, training: DataFrame | Column, weights: tuple[float, ...] = WEIGHTS, max_words: int | None = None) -> DataFrame:
    """Score the texts of ``docs`` by a model of ``training``: all columns but text, n_tokens, n_known, train_tokens, base_score, score.

    ``training``: a table with texts, or a condition that is true for the rows of ``docs`` to learn from, which reads them
    once less. A column of ``docs`` that has the name of one of the results is left out. ``max_words``: for older callers; no
    words are broadcast any more.
    """
    spark, order = docs.sparkSession, len(weights) + 1
    shared.small_batches(spark)
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    if isinstance(training, Column):
        flag = shared.fresh(docs, "__train")
        docs = docs.select("*", F.coalesce(training, F.lit(False)).alias(flag))
    docs = shared.located(docs)[0]  # written unless it's a scan: rows may come in another order when read again
    yes, no = F.lit(True), F.lit(False)
    if isinstance(training, Column):
        asking = [docs.select("text", yes.alias("ask"), F.col(flag).alias("train"))]
        docs = docs.drop(flag)
    else:
        asking = [docs.select("text", yes.alias("ask"), no.alias("train")), training.select("text", no.alias("ask"), yes.alias("train"))]
    parts = max(shared.parts(spark), -(-sum(map(shared.bytes_of, asking)) // PART))
    counted, folder = answers(asking, order, parts)
    means, n, v = totals(counted)
    bottom = float(n + v + 1)
    texts = docs.columns.index("text")
    kept = [(i, f) for i, f in enumerate(docs.schema) if f.name != "text" and f.name.lower() not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answered = Answers(folder, TaskContext.get().partitionId())
        for i, rows in enumerate(runs(batches)):
            h, text, longer = read(rows, order)
            n_rows = sum(b.num_rows for b in rows)
            size = np.bincount(text, minlength=n_rows)
            first = np.append(0, np.cumsum(size))
            unique, back = numbered(h)
            every = np.concatenate([h, *longer]) >> _S16
            every[len(h) :][np.concatenate([g == 0 for g in longer] or [np.empty(0, bool)])] = every[0]  # where there is no n-gram
            asked, place = numbered(every << _S16)
            found, exact = answered.of(i, asked >> _S16, unique, parts)
            base = np.add.reduceat(np.log10((exact + 1) / bottom)[back], first[:-1])
            n_known = np.add.reduceat((exact > 0)[back].astype(np.int64), first[:-1])
            found = found[place].reshape(order, len(h))
            p = interpolate(found[0], longer, list(found[1:]), means, bottom, weights)
            scores = np.add.reduceat(np.log10(p), first[:-1])
            done = 0
            for batch in rows:
                mine = slice(done, done + batch.num_rows)
                columns = [batch.column(i) for i, _ in kept] + [pa.array(x[mine]) for x in (size, n_known, base, scores)]
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for _, f in kept] + ["n_tokens", "n_known", "base_score", "score"])

    added = "n_tokens long, n_known long, base_score double, score double"
    out = docs.mapInArrow(run, StructType([f for _, f in kept] + _parse_datatype_string(added).fields))
    names = [F.col("`" + f.name.replace("`", "``") + "`") for _, f in kept]
    return out.select(*names, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 == 2
    docs = docs.select("doc_id", held_out.alias("held_out"), "text")
    return score(docs, ~F.col("held_out"))
