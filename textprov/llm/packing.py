"""Best-fit packing of documents into sequences of at most ``capacity`` tokens, by exact complements.

Pieces differ only by length, so packing needs just the histogram of lengths: ``capacity`` numbers,
whatever the input. ``plan`` packs that histogram on the driver: for the longest length left it looks up
the gap in a hash index of the sums of one, two and three lengths, takes a combination that fills it
exactly as long as its counts last, and the best fit where there is none, then looks again. Each pattern of lengths empties a length, so there are few
patterns. A piece finds its place by its rank among the pieces of its length; ranks come from counts
by (task, length), so no length, however common, is gathered anywhere.

Defined results: null text counts as empty (its end id alone is a piece); null ids and repeated rows
are packed as documents of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textscan, wordcache


class Complements:
    """Lengths still available, and a hash index from a sum to the combinations of one, two or three of them that make it.

    An entry, by (number of lengths, sum), holds the combination in use. Counts only fall, so a combination
    that was passed over never comes back: each entry moves on through its combinations once.
    """

    def __init__(self, counts: np.ndarray):
        self.left = np.asarray(counts).tolist()
        self.index: dict[tuple[int, int], list] = {}

    def _pairs(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        left = self.left
        for high in range(min(total - 1, most, len(left) - 1), (total - 1) // 2, -1):
            if left[high] and left[total - high]:
                yield high, total - high

    def _combinations(self, size: int, total: int) -> Iterator[tuple[int, ...]]:
        """Longest length first."""
        most = len(self.left) - 1
        if size == 1 and 0 < total <= most:
            yield (total,)
        elif size == 2:
            yield from self._pairs(total, most)
        elif size == 3:
            for longest in range(min(total - 2, most), (total + 2) // 3 - 1, -1):
                if self.left[longest]:
                    yield from ((longest, *pair) for pair in self._pairs(total - longest, longest))

    def _there(self, lengths: tuple[int, ...]) -> bool:
        return all(self.left[n] >= lengths.count(n) for n in lengths)

    def look(self, size: int, total: int) -> tuple[int, ...] | None:
        entry = self.index.get((size, total))
        if entry is None:
            more = self._combinations(size, total)
            entry = self.index[size, total] = [more, next(more, None)]
        while entry[1] is not None and not self._there(entry[1]):
            entry[1] = next(entry[0], None)
        return entry[1]

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that fill ``gap`` exactly; fewest first, then the longest."""
        return self.look(1, gap) or self.look(2, gap) or self.look(3, gap)

    def best(self, gap: int) -> int | None:
        return next((n for n in range(min(gap, len(self.left) - 1), 0, -1) if self.left[n]), None)


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, and how many sequences follow each. ``counts[n]``: pieces of length n."""
    index = Complements(counts)
    left, patterns = index.left, []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            pattern, gap = [longest], capacity - longest
            left[longest] -= 1
            while gap:
                fill = index.exact(gap)
                taken = fill or ((best,) if (best := index.best(gap)) else ())
                if not taken:
                    break
                for n in taken:
                    left[n] -= 1
                pattern += taken
                gap -= sum(taken)
            times = {n: pattern.count(n) for n in pattern}
            more = min(left[n] // k for n, k in times.items())
            for n, k in times.items():
                left[n] -= more * k
            patterns.append((tuple(pattern), more + 1))
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: first rank, first sequence, offset; sorted by (length, rank)."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {
        "rank": table[:, 1].copy(),
        "sequence": table[:, 2].copy(),
        "offset": table[:, 3].copy(),
        "begin": np.searchsorted(table[:, 0], np.arange(capacity + 2)),
    }


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, rank (within task and length), and ids if wished."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = wordcache.encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc_ids = batch["doc_id"].cast(pa.int64())
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                ids, counts = encoder.ids(data, offsets)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                sizes = counts + 1
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(hi - lo), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                head = sizes - (number - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(sorted_length, sorted_length) + seen[sorted_length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [
                    doc_ids.slice(lo, hi - lo).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start.astype(np.int64)),
                    pa.array(length.astype(np.int64)),
                    pa.array(np.array(crc, np.int64)),
                    pa.array(np.full(len(doc), task, np.int32)),
                    pa.array(rank),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(at.tolist(), (at + length).tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    shared.small_batches(docs.sparkSession)
    found = shared.written(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    counts = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = shared.written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    # at most ``capacity`` rows
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    table = slots(plan(histogram, capacity), capacity)
    kept = [f for f in found.schema if f.name not in ("task", "rank")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = int(table["rank"].max(initial=0)) + int(histogram.max()) + 1
        lengths = np.repeat(np.arange(capacity + 1), np.diff(table["begin"]))
        keys = lengths * span + table["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch[f.name] for f in kept]
                + [pa.array(table["sequence"][at] + rank - table["rank"][at]), pa.array(table["offset"][at])],
                names=[f.name for f in kept] + ["sequence_id", "offset"],
            )

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return found.join(counts.select("task", "length", "before"), ["task", "length"]).mapInArrow(
        place, f"{names}, sequence_id long, offset long"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids and offsets of each packed sequence; a group has ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return out.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
