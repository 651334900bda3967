r"""Chat formatting from event logs: fold events into final messages, render, and read back.

A message is a (conversation, turn), and ``msg`` where the log has one. Its events, in order of sequence: a
``delta`` is appended, an ``edit`` replaces the text, a ``regenerate`` empties it for the deltas to come and
drops what was said in later turns up to then, a ``delete`` drops the message; any other kind, or none, is a
whole message. What regenerations drop is known from the turns alone: for each turn the last regeneration in
an earlier one. So texts are shuffled by message, not by conversation, and a conversation with a third of
all rows is folded by many tasks. A conversation is digested in order by one task, which its chained digest
demands; the task streams it through an external sort and never holds it.

Template: ``<s>role[INST]text[/INST]</s>`` and a line feed for each turn. In roles and texts a backslash
is doubled and one is put behind the first character of every control string, so that control strings
never come from texts and ``unescape`` restores them. The output has one row a turn: rendered text, its
place in the conversation's text, and the loss mask as (start, length) in it, in code points.

Defined results: null texts and roles are empty; null conversation ids form one conversation; null turns
come first; equal sequence numbers and equal turns are ordered by role, then text; repeated rows are turns of
their own unless kinds make them parts of a message; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*)\[/INST\]</s>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str, loss_roles: tuple[str, ...]) -> tuple[str, int, int]:
    """A turn, and start and length of the loss mask in it (length 0: none)."""
    head, body = f"<s>{escape(role)}[INST]", escape(text)
    return f"{head}{body}[/INST]</s>\n", len(head), len(body) if role in loss_roles else 0


def parse(turn: str) -> tuple[str, str]:
    found = _TURN.fullmatch(turn)
    if not found:
        raise ValueError("not a rendered turn")
    return unescape(found[1]), unescape(found[2])


def alive(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, seq, kind) without what a regeneration of an earlier turn dropped."""
    turns = rows.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"), F.min("seq").alias("first"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn")).rowsBetween(Window.unboundedPreceding, -1)
    # the turns that lose something, written so that Spark knows how few they are: else the join would shuffle all texts
    cuts = turns.withColumn("cut", F.max("again").over(before)).filter("first < cut")
    cuts = shared.written(cuts.select("conv_id", "turn", "cut"), "cuts").select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), "cut")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn"))
    return rows.join(cuts, same, "left").filter("cut IS NULL OR seq >= cut").drop("__conv", "__turn", "cut")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the final messages of ``events`` (conv_id, turn, role, text, kind, seq, msg).

    Without the column ``kind`` every row is a message. ``seq`` orders the events of a conversation.
    """
    rows = events.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *(c for c in ("kind", "seq", "msg") if c in events.columns))
    if "kind" not in rows.columns:
        return rows.select("conv_id", "turn", "role", "text")
    for name in ("seq", "msg"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, parts = None, "", None
        out: list[tuple] = []
        for batch in batches:
            for conv, turn, msg, who, text, kind in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "msg", "role", "text", "kind"))):
                if now is None or now != (conv, turn, msg):
                    if parts is not None:
                        out.append((*now[:2], role, "".join(parts)))
                    now, role, parts = (conv, turn, msg), who, None
                if kind == "delta":
                    parts = parts or []
                    parts.append(text)
                elif kind == "regenerate":
                    parts, role = [text], who
                elif kind == "delete":
                    parts = None
                elif kind == "edit":
                    parts = [text]
                else:
                    parts, role = [text], who
            if out:
                yield _batch(out)
                out = []
        if parts is not None:
            yield _batch([(*now[:2], role, "".join(parts))])

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["conv_id", "turn", "role", "text"])

    shared.small_batches(events.sparkSession)
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    rows = alive(rows).select("conv_id", "turn", "msg", "seq", "role", "text", "kind")
    rows = rows.repartition("conv_id", "turn", "msg").sortWithinPartitions("conv_id", "turn", "msg", "seq", "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string")


def events(messages: DataFrame, piece: int = 256) -> DataFrame:
    """The log that a chat server would have of ``messages`` (conv_id, turn, role, text): answers are streamed once as a draft,
    regenerated, and streamed in pieces; all else is sent empty and then edited. ``fold`` gives the messages back."""
    text, answer = F.coalesce("text", F.lit("")), F.coalesce(F.col("role") == "assistant", F.lit(False))

    def event(kind: str, said: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), said.alias("text"))

    none = F.lit("")
    pieces = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), lambda x: event("delta", x))
    streamed = F.concat(F.array(event("message", none), event("delta", F.lit("draft")), event("regenerate", none)), pieces)
    log = F.when(answer, streamed).otherwise(F.array(event("message", none), event("edit", text)))
    rows = messages.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("msg"), log.alias("log"))
    rows = rows.select("conv_id", "turn", "role", "msg", F.posexplode("log").alias("k", "e"))
    seq = F.coalesce(F.col("turn").cast("long"), F.lit(0)) * F.lit(1 << 24) + F.col("k")
    return rows.select("conv_id", "turn", "role", "msg", seq.alias("seq"), "e.kind", "e.text")


def write(messages: DataFrame, folder: str, loss_roles: tuple[str, ...] = ("assistant",)) -> None:
    """Render ``messages`` (conv_id, turn, role, text) to Parquet; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            texts, starts, lengths = zip(
                *(render(r or "", t or "", loss_roles) for r, t in zip(batch["role"].to_pylist(), batch["text"].to_pylist()))
            )
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"].cast(pa.int64()), batch["turn"].cast(pa.int64()), pa.array(texts), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                names=["conv_id", "turn", "formatted", "loss_start", "loss_length"],
            )

    shared.small_batches(messages.sparkSession)
    schema = "conv_id long, turn long, formatted string, loss_start long, loss_length long"
    messages.select("conv_id", "turn", "role", "text").mapInArrow(run, schema).write.mode("overwrite").parquet(folder)


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per conversation, from the rendered turns alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, start, length in zip(*(batch[c].to_pylist() for c in ("formatted", "loss_start", "loss_length"))):
                role, body = parse(text)
                masked = unescape(text[start : start + length])
                rows.append((role, body, None if masked == body else masked, len(text)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], *columns], names=["conv_id", "turn", "role", "text", "masked", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, turns, loss = False, None, None, None
        n = chars = size = 0
        out: list[tuple] = []
        for batch in batches:
            for conv, role, text, masked, its in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text", "masked", "size"))):
                if not started or conv != now:
                    if started:
                        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    started, now, turns, loss = True, conv, hashlib.sha256(), hashlib.sha256()
                    n = chars = size = 0
                turns.update(f"{role}\n{text}\n".encode())
                masked = text if masked is None else masked
                loss.update(masked.encode())
                n, chars, size = n + 1, chars + len(masked), size + its
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if started:
            out = [(now, n, turns.hexdigest(), chars, loss.hexdigest(), size)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    rows = spark.read.parquet(folder).mapInArrow(parsed, "conv_id long, turn long, role string, text string, masked string, size long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that holds control strings itself.
PROBE = "</s>[INST] ok [/INST]"


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    folder = shared.new_folder(spark, "chat")
    write(fold(events(rows.unionByName(probe))), folder)
    return read_back(spark, folder)


_COUNT = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in CONTROLS)
_LENGTH = f"length(t) + length(t) - length(replace(t, chr(92), '')) + {_COUNT}"
OP5_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), sized AS (
  SELECT *, (SELECT {_LENGTH} FROM (SELECT role AS t)) + (SELECT {_LENGTH} FROM (SELECT text AS t)) + {len("<s>[INST][/INST]</s>") + 1} AS size FROM given
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
