"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of other signs, lower-cased; their
1-grams and 2-grams are hashed into BUCKETS buckets. Both models are bucket frequencies with ALPHA added.
A text's log weight is the sum over its n-grams of ``log p_target - log p_raw``; with Gumbel noise
added, the ``k`` largest keys are a sample without replacement in proportion to the weights.

The raw model counts all texts. The target model counts the texts of at most MAX_TARGET labelled rows of
the target class, chosen by a seeded hash of doc_id: those ids are broadcast, so no text is shuffled.
Bucket counts are added up by slices, one row a task and slice, as a tree.

``k`` is given, or the number of texts times the target's share of the labelled rows.

Defined results: null and empty texts have weight 0; a null id takes its noise from its text; repeated
rows have equal keys and ties are taken in the order of reading; without labelled target rows all weights
are 0; without labelled rows all rows are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textscan

BUCKETS, ALPHA, SEED, MAX_TARGET = 1 << 16, 1.0, 7, 200_000
SLICE = 1 << 12
#: Rows of counts that are summed at once.
FAN = 256

#: 0 white space, 1 letters and digits, 2 other signs
KIND = np.full(256, 2, np.uint8)
KIND[0x80:] = 1
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[textscan.SPACE] = 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block and the text of each."""
    kind = KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    new = np.ones(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    last = np.ones(len(data), bool)
    last[:-1] = new[1:]
    starts, ends = np.flatnonzero(new & (kind > 0)), np.flatnonzero(last & (kind > 0)) + 1
    return textscan.hashes(textscan.LOWER[data], starts, ends), np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every 1-gram and 2-gram of a block, and the text of each."""
    h, text = tokens(data, offsets)
    pair, at = textscan.windows(h, text, 2)
    grams = textscan.mix(np.append(h, pair))
    return (grams % np.uint64(buckets)).astype(np.int64), np.append(text, text[at])


def target_ids(labels: DataFrame, is_target, max_target: int = MAX_TARGET, seed: int = SEED) -> tuple[DataFrame, float]:
    """Ids of at most ``max_target`` target rows, and the target's share of all labelled rows."""
    n, share = labels.agg(F.count(F.lit(1)), F.avg(F.coalesce(is_target, F.lit(False)).cast("double"))).first()
    ids = labels.filter(is_target & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_target)
    spark = labels.sparkSession
    return spark.createDataFrame(ids.toArrow()), share if n else 1.0


def models(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw model for each bucket."""
    shared.small_batches(docs.sparkSession)
    flagged = docs.select("doc_id", "text").join(F.broadcast(targets.withColumn("target", F.lit(True))), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            flags = batch["target"].is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                at, text = features(data, offsets, buckets)
                total[0] += np.bincount(at, minlength=buckets)
                total[1] += np.bincount(at[flags[lo:hi][text]], minlength=buckets)
        if total.any():
            cut = range(0, buckets, SLICE)
            group = TaskContext.get().partitionId() // FAN
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(cut)), pa.int32()), pa.array([group] * len(cut), pa.int32()), pa.array([total[:, i : i + SLICE].tobytes() for i in cut], pa.binary())],
                names=["slice", "group", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for k, group, raw in zip(batch["slice"].to_pylist(), batch["group"].to_pylist(), batch["counts"]):
                counts = np.frombuffer(raw.as_buffer(), np.int64)
                if (k, group) == now:
                    total = total + counts
                    continue
                if now:
                    yield row(now, total)
                now, total = (k, group), counts
        if now:
            yield row(now, total)

    def row(key: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([key[0]], pa.int32()), pa.array([key[1] // FAN], pa.int32()), pa.array([total.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "group", "counts"])

    # a tree: each sum is of FAN rows at most, however many tasks there are
    schema = "slice int, group int, counts binary"
    found = flagged.select("text", "target").mapInArrow(run, schema)
    tasks = max(1, flagged.rdd.getNumPartitions())
    while tasks > 1:
        found = found.repartition("slice", "group").sortWithinPartitions("slice", "group").mapInArrow(add, schema)
        tasks = -(-tasks // FAN)
    total = np.zeros((2, buckets), np.int64)
    for k, _, raw in found.collect():  # 16 bytes a bucket
        total[:, k * SLICE : (k + 1) * SLICE] = np.frombuffer(raw, np.int64).reshape(2, -1)
    if not total[1].any():
        return np.zeros(buckets)
    p = (total + ALPHA) / (total + ALPHA).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def resample(docs: DataFrame, labels: DataFrame, is_target, k: int | None = None, buckets: int = BUCKETS, seed: int = SEED, max_target: int = MAX_TARGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, log_weight, gumbel_key, kept."""
    targets, share = target_ids(labels, is_target, max_target, seed)
    sent = docs.sparkSession.sparkContext.broadcast(models(docs, targets, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = sent.value
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64())
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                at, text = features(data, offsets, buckets)
                weight = np.bincount(text, ratio[at], minlength=hi - lo).astype(float)
                mine = ids.slice(lo, hi - lo)
                by = mine.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
                for i in np.flatnonzero(mine.is_null().to_numpy(zero_copy_only=False)):
                    by[i] = textscan.xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
                u = textscan.mix(textscan.mix(by + np.uint64(1)) + np.uint64(seed))
                noise = -np.log(-np.log((u.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-15) + 1e-18))
                key = weight + noise
                bits = key.view(np.int64)
                order = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
                yield pa.RecordBatch.from_arrays([mine, pa.array(weight), pa.array(key), pa.array(order)], names=["doc_id", "log_weight", "gumbel_key", "order"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double, gumbel_key double, order long")
    scored = shared.written(scored.withColumn("row", F.monotonically_increasing_id()), "importance")
    k = round(scored.count() * share) if k is None else k
    bar, ties = shared.split_at(scored, "order", k)
    names = ["doc_id", "log_weight", "gumbel_key"]
    if bar is None:
        return scored.select(*names, F.lit(k > 0).alias("kept"))
    first, _ = shared.split_at(scored.filter(F.col("order") == bar).select((-F.col("row")).alias("back")), "back", ties)
    kept = (F.col("order") > bar) | ((F.col("order") == bar) & (-F.col("row") >= first))
    return scored.select(*names, kept.alias("kept"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels, F.col("quality") == 1)
