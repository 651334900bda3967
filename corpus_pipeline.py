"""The corpus pipeline: quality rules, exact and near de-duplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet into the
shared folder and rereads it as the next stage's ``docs``. All stages but the last return the columns
of ``docs``, so stages can be left out or reordered; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textprov.llm import exact_dedup, minhash, mixing, packing, quality_rules, shared

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and lie near their language's reference. Null and empty texts fail; null ids, ties and
    repeated rows are judged each for itself; columns of any name are passed on; an empty table stays empty."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row of the largest doc_id, a null id below all others; one of rows that are
    equal in both. Columns of any name are passed on; an empty table stays empty."""
    return exact_dedup.keep(docs, exact_dedup.DigestIndex(spark, shared.new_folder(spark, "digest-index")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near copies. Texts without words are linked with nothing; rows that share
    an id share its fate; null ids stay where their group has no other. Columns of any name are passed on; an empty table stays empty."""
    return minhash.keep(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row 0 to ``MAX_EPOCHS`` times, by its source's budget of tokens. Null texts have no tokens, null names are '', repeated
    rows are rows of their own, ties of the hash are ordered by id. Columns of any name are passed on; an empty table stays empty."""
    return mixing.mix(docs, TOKENIZER, weights=mixing.WEIGHTS, domains=mixing.DOMAINS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, placed in sequences. A null or empty text is its end id; null ids and repeated rows are documents of
    their own; other columns are not read; an empty table gives no pieces."""
    return packing.pack(docs, TOKENIZER, end_id=2)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: SQL can't express distances from learned references, MinHash groups or tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
