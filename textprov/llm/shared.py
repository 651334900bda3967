"""Shared-folder tables, skew-safe joins and id lookups used by the operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the rows; at most 1/HOT_SHARE keys can be hot.
HOT_SHARE = 1 / 500

_written: list[tuple[SparkSession, str]] = []


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; where it is unset, one of our own in local mode and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="textprov-"))
    return _own[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the driver ends, or by ``clean``."""
    path = f"{shared_folder(spark)}/textprov/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def clean() -> None:
    """Remove every table that this driver wrote into the shared folder."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            remove(spark, path)


@contextlib.contextmanager
def scratch() -> Iterator[list]:
    """Removes the tables and folders that are made inside, but for those put into the list (paths, or what ``written`` returned)."""
    before, kept = {path for _, path in _written}, []
    yield kept
    stay = before | {getattr(x, "written_at", x) for x in kept}
    for spark, path in [x for x in _written if x[1] not in stay]:
        remove(spark, path)
        _written.remove((spark, path))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


# Decisions by row. A row of a Parquet file is known by the hash of the file's path and by its number in the
# file, whatever split or task reads it. Decisions are written by file and CHUNK rows, and each task that scans
# the file reads its own: texts are never shuffled to apply a decision, and nothing is broadcast.

CHUNK = 1 << 20


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with more underscores where ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _nodes(plan) -> Iterator:
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))


def bytes_of(docs: DataFrame) -> int:
    """Bytes of the files that ``docs`` reads."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    return sum(int(x.stats().sizeInBytes()) for x in _nodes(plan) if x.nodeName() == "LogicalRelation")


def located(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` and the columns of file and row that place each of its rows; written first unless it only selects and filters rows of Parquet files."""
    for again in (False, True):
        try:
            if {x.nodeName() for x in _nodes(docs._jdf.queryExecution().analyzed())} <= {"Project", "Filter", "LogicalRelation"}:
                meta = docs.metadataColumn("_metadata")
                file, row = F.xxhash64(meta["file_path"]), meta["row_index"]
                docs.select(file, row)
                return docs, file, row
        except AnalysisException:
            if again:
                raise
        docs = written(docs, "docs")
    raise AssertionError("a written table has rows that can be placed")


def save_decisions(rows: DataFrame, name: str) -> str:
    """Write ``rows`` (file long, row long, value long) by file and chunk; the folder. A task holds one chunk."""
    spark = rows.sparkSession
    folder = new_folder(spark, name)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = place(folder)
        fs.create_dir(at, recursive=True)
        held, now, n = [], None, 0

        def close() -> None:
            rows, values = (np.concatenate(x) for x in zip(*held))
            raw = pa.compress(np.diff(rows, prepend=0).astype("<i4").tobytes() + values.astype("<i8").tobytes(), codec="zstd", asbytes=True)
            tmp = f"{at}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(tmp) as out:
                out.write(np.int64(len(rows)).tobytes() + raw)
            fs.move(tmp, f"{at}/{now[0] & (1 << 64) - 1:016x}-{now[1]}")

        for batch in batches:
            file, row, value = (batch[c].to_numpy() for c in ("file", "row", "value"))
            chunk = row // CHUNK
            cut = np.flatnonzero((file[1:] != file[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(row)]):
                if lo == hi:
                    continue
                key = (int(file[lo]), int(chunk[lo]))
                if held and key != now:
                    close()
                    held = []
                now = key
                held.append((row[lo:hi] - chunk[lo] * CHUNK, value[lo:hi]))
            n += len(row)
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = rows.select("file", "row", F.col("value").cast("long").alias("value")).repartition(parts(spark), "file", F.floor(F.col("row") / CHUNK))
    rows.sortWithinPartitions("file", "row").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


class Decisions:
    def __init__(self, folder: str, default: int):
        self.fs, self.at = place(folder)
        self.default, self.held = default, {}

    def chunk(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        if key not in self.held:
            if len(self.held) >= 4:
                self.held.pop(next(iter(self.held)))
            path = f"{self.at}/{key[0] & (1 << 64) - 1:016x}-{key[1]}"
            if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
                self.held[key] = np.empty(0, np.int64), np.empty(0, np.int64)
            else:
                with self.fs.open_input_file(path) as f:
                    raw = f.read()
                n = int(np.frombuffer(raw, "<i8", 1)[0])
                body = pa.decompress(raw[8:], 12 * n, codec="zstd", asbytes=True)
                self.held[key] = np.cumsum(np.frombuffer(body, "<i4", n), dtype=np.int64), np.frombuffer(body, "<i8", n, 4 * n)
        return self.held[key]

    def look(self, file: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.full(len(row), self.default, np.int64)
        chunk = row // CHUNK
        cut = np.flatnonzero((file[1:] != file[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(row)]):
            if lo == hi:
                continue
            rows, values = self.chunk((int(file[lo]), int(chunk[lo])))
            if len(rows):
                mine = row[lo:hi] - chunk[lo] * CHUNK
                at = np.minimum(np.searchsorted(rows, mine), len(rows) - 1)
                out[lo:hi] = np.where(rows[at] == mine, values[at], self.default)
        return out


def decided(folder: str, default: int, file: Column, row: Column) -> Column:
    """The value saved for each row, ``default`` for rows without one. Only the two numbers go through Python."""

    @F.pandas_udf("long")
    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held = Decisions(folder, default)
        for files, rows in batches:
            yield pd.Series(held.look(files.to_numpy(), rows.to_numpy()))

    return look.asNondeterministic()(file, row)  # so that it isn't evaluated twice


def copies(docs: DataFrame, file: Column, row: Column, folder: str, default: int) -> DataFrame:
    """Each row of ``docs`` as often as was decided, with the columns of ``docs`` alone, whatever they are called."""
    name, each = fresh(docs, "__copies"), fresh(docs, "__copy")
    out = docs.select("*", decided(folder, default, file, row).alias(name)).filter(f"{name} > 0")
    out = out.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(name).cast("int"))))
    return out.drop(name, each)


def kept(docs: DataFrame, file: Column, row: Column, folder: str) -> DataFrame:
    """The rows of ``docs`` that no decision of 0 is saved for."""
    name = fresh(docs, "__kept")
    return docs.select("*", decided(folder, 1, file, row).alias(name)).filter(f"{name} > 0").drop(name)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join ``rows`` with ``groups`` (one row a key, ``size``: the key's rows), safe for hot keys.

    Keys that hold at least HOT_SHARE of all grouped rows are joined by broadcast: there are at most
    1/HOT_SHARE of them, whatever the input. No other key can fill a partition, so the rest is a
    sort-merge join. ``rows`` is read twice and should be cheap to read. Null keys match nothing.
    """
    spark = rows.sparkSession
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.filter(F.col(size) >= max(2, total * HOT_SHARE))
    hot = spark.createDataFrame(hot.limit(int(1 / HOT_SHARE) + 1).collect(), groups.schema)
    extra = [c for c in groups.columns if c != key]
    left = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    done = left.filter(F.col("__hot")).drop("__hot")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    cold = cold.join(groups.filter(F.col(size) < max(2, total * HOT_SHARE)), key, "left")
    order = rows.columns + extra
    return done.select(*order).unionByName(cold.select(*order))


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound Arrow batches by bytes, so that Python workers stay small whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def split_at(rows: DataFrame, key: str, k: int) -> tuple[int | None, int]:
    """Radix select: the ``k``-th largest value of the long column ``key``, and how many rows with it are among the ``k``.

    Four counts of at most 65,536 groups each; no sort and no hot group. None where there are fewer
    than ``k`` rows or ``k`` is 0.
    """
    if k <= 0:
        return None, 0
    shifted = F.col(key).bitwiseXOR(F.lit(-(2**63)))
    rows, prefix, left = rows.select(shifted.alias("u")), None, k
    for shift in (48, 32, 16, 0):
        here = rows if prefix is None else rows.filter(F.shiftrightunsigned("u", shift + 16) == F.lit(prefix))
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF)).alias("d")
        counts = sorted(((r["d"], r["count"]) for r in here.groupBy(digit).count().collect()), reverse=True)
        for d, n in counts:
            if left <= n:
                prefix = d if prefix is None else prefix << 16 | d
                break
            left -= n
        else:
            return None, 0
    value = prefix ^ (1 << 63)
    return (value - (1 << 64) if value >= 1 << 63 else value), left
