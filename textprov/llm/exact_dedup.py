"""Exact de-duplication with a persistent digest index.

The index is a Parquet table in the shared folder, bucketed and sorted by SHA-256 digest. A batch is
reduced to one row a digest (map-side first, so a hot text is one row a task), joined with the index
by sort-merge on the digest, and the digests that the index lacks are appended.

An append counts from when its batch is committed, by a small file of its own; a batch that runs again
under its name ignores what it appended before and takes its place, so a run that broke off is repeated
without loss.

Defined results: null text counts as empty; among equal texts the largest doc_id stays, a null
doc_id ranking below all others; of rows repeated with the same id and text one stays; a text that
the index already had stays with the row that brought it. Empty tables give empty results. Columns
other than doc_id and text are never read by ``decide`` and are passed on by ``keep``, whatever they
are called.
"""

from __future__ import annotations

import hashlib
import random
import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LOWEST = -(2**63)


def digest(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """A bucketed table (digest, keep_id, attempt) at ``path``; ``buckets`` is fixed when the table is made."""

    SCHEMA = "digest BINARY, keep_id BIGINT, attempt BIGINT"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.table = f"textprov_digests_{hashlib.md5(path.encode()).hexdigest()}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = [int(n.split("=")[1]) for n in self._named("_buckets=*")]
        self.buckets = found[0] if found else buckets or shared.parts(spark)
        if not found:
            self.fs.mkdirs(self._path(path))
            self.fs.create(self._path(f"{path}/_buckets={self.buckets}")).close()
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        spark.sql(
            f"CREATE TABLE {self.table} ({self.SCHEMA}) USING parquet OPTIONS (path '{path}') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
        )

    def _named(self, pattern: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.globStatus(self._path(f"{self.path}/{pattern}")) or []]

    def batches(self) -> dict[str, int]:
        """The attempt that counts of each committed batch."""
        return {urllib.parse.unquote(n.split("=")[1]): int(n.split("=")[2]) for n in self._named("_commit=*")}

    def read(self, without: str | None = None) -> DataFrame:
        """digest and keep_id of all committed batches but ``without``."""
        attempts = [a for name, a in self.batches().items() if name != without]
        rows = self.spark.table(self.table)
        return rows.filter(F.col("attempt").isin(attempts) if attempts else F.lit(False)).select("digest", "keep_id")

    def append(self, new: DataFrame, batch: str) -> None:
        """Write each bucket by one task, so that an append adds one sorted file a bucket, and commit ``batch``."""
        attempt, name = random.SystemRandom().getrandbits(62), urllib.parse.quote(batch, safe="")
        new = new.select("digest", "keep_id", F.lit(attempt).alias("attempt")).repartition(self.buckets, "digest")
        new.write.insertInto(self.table)
        # without its old mark the batch isn't committed, and has to run again if this stops here
        for old in self._named(f"_commit={name}=*"):
            self.fs.delete(self._path(f"{self.path}/{old}"), False)
        self.fs.create(self._path(f"{self.path}/_commit={name}={attempt}")).close()

    def decide(self, rows: DataFrame, batch: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """One row per row of ``rows``: doc_id, digest, keep_id, group_size, kept and ``carry``; new digests are appended under the name ``batch``."""
        batch = batch or uuid.uuid4().hex
        rows = rows.select("doc_id", digest().alias("digest"), F.monotonically_increasing_id().alias("nr"), *carry)
        rows = shared.written(rows, "digests")
        groups = rows.groupBy("digest").agg(
            F.max("doc_id").alias("last_id"),
            F.max_by("nr", F.coalesce("doc_id", F.lit(LOWEST))).alias("last_nr"),
            F.count(F.lit(1)).alias("group_size"),
        )
        known = self.read(batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
        state = shared.written(groups.hint("merge").join(known.hint("merge"), "digest", "left"), "groups")
        self.append(state.filter(F.col("known").isNull()).select("digest", F.col("last_id").alias("keep_id")), batch)
        shown = state.filter((F.col("group_size") > 1) | F.col("known"))
        out = shared.join_groups(rows, shown, "digest", "group_size")
        alone = F.col("group_size").isNull()
        return out.select(
            "doc_id",
            "digest",
            F.when(alone, F.col("doc_id")).when(F.col("known"), F.col("known_id")).otherwise(F.col("last_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("known").isNull() & (F.col("nr") == F.col("last_nr")))).alias("kept"),
            *carry,
        )


def keep(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; decisions are applied where rows are read, so no text is shuffled."""
    docs, file, row = shared.located(docs)
    with shared.scratch() as stays:
        rows = docs.select("doc_id", "text", file.alias("file"), row.alias("row"))
        out = index.decide(rows, batch, ("file", "row")).filter(~F.col("kept"))
        folder = shared.save_decisions(out.select("file", "row", F.lit(0).alias("value")), "dropped")
        stays.append(folder)
    return shared.kept(docs, file, row, folder)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches against one index, the one of larger ids first: its rows stay where both have a text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, shared.new_folder(spark, "digest-index"))
    middle = docs.select(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    first = F.coalesce(F.col("doc_id") >= middle, F.lit(False))
    done = [index.decide(docs.filter(mine), name) for mine, name in ((first, "first"), (~first, "second"))]
    rows = shared.written(done[0].unionByName(done[1]).drop("group_size"), "decided")
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    out = shared.join_groups(rows, shared.written(sizes, "sizes"), "digest", "group_size")
    size = F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size")
    return out.select("doc_id", "keep_id", size, "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
