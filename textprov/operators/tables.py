"""Written tables, numbering and running sums without a task that holds everything."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own in local mode and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="textprov-"))
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once: written as Parquet into the shared folder, read back, removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textprov/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound Arrow batches by bytes, so that Python workers stay small whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@atexit.register
def clean() -> None:
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ranged(df: DataFrame, order: Column, sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with running sums up to each row in the order of ``order``, which should be without ties.

    Rows are cut into ranges, sorted within each by its own task; what the ranges before hold is added.
    """
    parts = written(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).withColumns({f"__{k}": c for k, c in sums.items()}), name)
    whole = parts.groupBy("__part").agg(*(F.sum(f"__{k}").alias(f"__of_{k}") for k in sums))
    # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(F.col("__part").alias("__p"), *(F.coalesce(F.sum(f"__of_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in sums))
    up_to = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.withColumns({k: F.sum(f"__{k}").over(up_to) for k in sums})
    out = rows.join(F.broadcast(whole), F.col("__part") == F.col("__p"))
    return out.select(*df.columns, *((F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums))


def first_in_groups(df: DataFrame, by: list[str], key: Column, ties: list[str], k: Column, name: str) -> DataFrame:
    """``df`` with ``name``: whether a row is among the first ``k`` of its group by ``key`` (hexadecimal digits) and ``ties``.

    ``k`` may use ``size``, the group's rows. Rows are counted by 4096 ranges of the key; only the range where
    the ``k`` end is ordered, so a group with a third of all rows is no task of its own.
    """
    rows = written(df.withColumns({"__key": key, "__range": F.substring(key, 1, 3)}), "ranked")
    at = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(at), F.lit(0)), "size": F.sum("__n").over(Window.partitionBy(*by))})
    counts = counts.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__range").alias("__r"), "__before", "__n", k.alias("__k"))
    same = (F.col("__range") == F.col("__r")) & F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    # a group's ranges are 4096 keys, so none of them is hot
    rows = rows.join(counts, same)
    ends = (F.col("__before") < F.col("__k")) & (F.col("__before") + F.col("__n") > F.col("__k"))
    rank = F.row_number().over(Window.partitionBy(*by, "__range").orderBy("__key", *ties))
    inside = rows.filter(ends).withColumn(name, F.col("__before") + rank <= F.col("__k"))
    outside = rows.filter(~ends).withColumn(name, F.col("__before") < F.col("__k"))
    return inside.unionByName(outside).select(*df.columns, name)
