"""Exact, seeded sampling and splitting, union and de-duplication of labelled corpora.

Order is by md5 of 'seed:doc_id', which any engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables


def order_key(seed: int, key: str = "doc_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, n: int, by: str = "label", seed: int = 42, strict: bool = True) -> DataFrame:
    """Exactly ``n`` distinct rows of each stratum; with ``strict`` a stratum of fewer rows raises an error."""
    df = df.distinct()
    if strict:
        short = df.groupBy(by).count().filter(F.col("count") < n).limit(1).collect()
        if short:
            raise ValueError(f"stratum {short[0][0]!r} has {short[0][1]} rows, {n} are wanted")
    return tables.first_in_groups(df, [by], order_key(seed), ["doc_id"], F.lit(n), "__in").filter("__in").drop("__in")


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` distinct rows, or all if there are fewer."""
    return df.distinct().orderBy(order_key(seed), "doc_id").limit(n)


def stratified_split(df: DataFrame, by: list[str], test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with is_test: round(share * n) rows of each stratum."""
    return tables.first_in_groups(df, by, order_key(seed), ["doc_id"], F.floor(F.lit(test_share) * F.col("size") + 0.5), "is_test")


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in a seeded order, by ranges of it."""
    return df.orderBy(order_key(seed), "doc_id")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """By name; columns that a frame lacks are null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def distinct_texts(df: DataFrame, keys: list[str], order: str = "doc_id") -> DataFrame:
    """Of rows equal in ``keys`` the one of lowest ``order``; keys are digests, and partial aggregation keeps a hot text cheap."""
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(digest.alias("__digest")).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def unpivot_pairs(df: DataFrame, human: str = "human", ai: str = "ai") -> DataFrame:
    """label (0 human, 1 ai) and text."""
    return df.select(F.explode(F.array(F.struct(F.lit(0).alias("label"), F.col(human).alias("text")), F.struct(F.lit(1).alias("label"), F.col(ai).alias("text")))).alias("r")).select("r.*")
