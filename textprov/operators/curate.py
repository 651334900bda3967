"""Loaders that shape labelled corpora alike: label and text, some with the name of the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chat_logs
from ..functions.text import clean_rows
from . import sampling

#: Labels by kind of corpus.
HUMAN, AI = 0, 1


def labelled(df: DataFrame, label: int, name: str | None = None) -> DataFrame:
    """``df`` with one label for all rows, whatever it had, and the corpus's name."""
    df = df.withColumn("label", F.lit(label).cast("tinyint"))
    return df.withColumn("dataset", F.lit(name)) if name else df


def cast_label(df: DataFrame, column: str = "label") -> DataFrame:
    """The label as a small number; one that doesn't fit raises an error."""
    return df.withColumn(column, F.col(column).cast("tinyint"))


def drop_columns(df: DataFrame, *names: str, strict: bool = False) -> DataFrame:
    """Without the columns; with ``strict`` one that isn't there raises an error."""
    missing = set(names) - set(df.columns)
    if strict and missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


def _turns(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both conversations of each row, one below the other."""
    return df.select(F.explode(F.array(a, b)).alias("turns"))


def arena(df: DataFrame, name: str, a: str = "conversation_a", b: str = "conversation_b") -> DataFrame:
    """Answers of two conversations of flat messages (role, content), labelled AI; not cleaned."""
    rows = _turns(df, a, b).select(F.explode(chat_logs.answers(F.col("turns"))).alias("m"))
    return labelled(rows.select(F.col("m.content").alias("text")), AI, name)


def arena_parts(df: DataFrame, name: str, a: str = "conversation_a", b: str = "conversation_b") -> DataFrame:
    """Texts among the parts of answers of two conversations, labelled AI and cleaned."""
    rows = _turns(df, a, b).select(F.explode(chat_logs.answers(F.col("turns"))).alias("m"))
    rows = rows.select(F.explode("m.content").alias("part")).filter("part.type = 'text'").select("part.text")
    return labelled(clean_rows(rows), AI, name)


def arena_printed(df: DataFrame, name: str, a: str = "messages_a", b: str = "messages_b") -> DataFrame:
    """``arena_parts`` of conversations stored in printed form."""
    parsed = df.select(chat_logs.conversation(F.col(a)).alias("a"), chat_logs.conversation(F.col(b)).alias("b"))
    return arena_parts(parsed, name, "a", "b")


#: How a source enters the corpus: all of it, n rows, or n of each label.
MODES = ("all", "sample", "strata")


def by_quotas(sources: dict[str, DataFrame], quotas: list[tuple[str, str, int | None]], seed: int = 42) -> DataFrame:
    """The curated corpus: each source by its quota (name, mode, n), united by name, one row for each text and label.

    Sources need doc_id, text and label; of equal texts the row of the source that comes first stays.
    """
    parts = []
    for at, (name, mode, n) in enumerate(quotas):
        if mode not in MODES:
            raise ValueError(f"{name}: no mode {mode!r}")
        df = sources[name]
        df = df if mode == "all" else sampling.sample(df, n, seed) if mode == "sample" else sampling.stratified_sample(df, n, seed=seed)
        parts.append(df.withColumns({"dataset": F.lit(name), "__order": F.struct(F.lit(at).alias("at"), "doc_id")}))
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return sampling.distinct_texts(whole, ["text", "label"], "__order").drop("__order")
