"""Conversations that were stored as the printed form of Python objects.

Literals are parsed, never evaluated. Printed arrays (``array([...], dtype=object)``) become lists, and
messages that stand side by side without commas are taken one by one.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MESSAGES = "array<struct<role: string, content: array<struct<type: string, text: string, image: string, mimeType: string>>, num_tokens: double>>"
_DTYPE = re.compile(r",\s*dtype\s*=\s*[^)\]]+$")
_PARTS = ("type", "text", "image", "mimeType")


def closing(s: str, start: int, pair: str) -> int:
    """Where the bracket that opens first from ``start`` on closes, quoted strings left out; -1 if it doesn't."""
    depth, quote, i = 0, "", start
    for found in re.compile(r"\\.|['\"]|[" + re.escape(pair) + "]", re.DOTALL).finditer(s, start):
        c, i = found[0], found.start()
        if c[0] == "\\":
            continue
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        else:
            depth += 1 if c == pair[0] else -1
            if not depth:
                return i
    return -1


def unarrayed(s: str) -> str:
    """``array(x, dtype=...)`` as a list; the rest of a text whose array doesn't close stays."""
    out, at = [], 0
    while (begin := s.find("array(", at)) >= 0:
        end = closing(s, begin, "()")
        if end < 0:
            break
        inner = unarrayed(_DTYPE.sub("", s[begin + 6 : end].rstrip()))
        out += [s[at:begin], inner if inner.lstrip().startswith("[") else f"[{inner}]"]
        at = end + 1
    return "".join(out) + s[at:]


def objects(s: str) -> list[str]:
    """The outermost {...} of a text."""
    out, at = [], 0
    while (begin := s.find("{", at)) >= 0 and (end := closing(s, begin, "{}")) >= 0:
        out.append(s[begin : end + 1])
        at = end + 1
    return out


def _literal(s: str):
    try:
        return ast.literal_eval(s)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


def parse(s: str | None) -> list | None:
    """The messages of a printed conversation; null where there are none to be found."""
    if s is None:
        return None
    plain = unarrayed(s.strip())
    found = _literal(plain)
    if isinstance(found, dict):
        found = [found]
    if not isinstance(found, (list, tuple)) or not all(isinstance(x, dict) for x in found):
        parts = objects(plain)
        found = [_literal(x) for x in parts] if parts else _literal(f"[{plain}]")
    return None if found is None else [_message(x) for x in found]


def _message(x) -> dict | None:
    if not isinstance(x, dict):
        return None
    content = x.get("content")
    if isinstance(content, str):
        content = [{"type": "text", "text": content}]
    if content is not None:
        content = [{k: None if p.get(k) is None else str(p[k]) for k in _PARTS} if isinstance(p, dict) else None for p in content]
    tokens = x.get("num_tokens")
    return {"role": None if x.get("role") is None else str(x["role"]), "content": content, "num_tokens": None if tokens is None else float(tokens)}


def conversation(c: Column) -> Column:
    """A column of printed conversations as MESSAGES."""

    @pandas_udf(MESSAGES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(parse, na_action="ignore").where(texts.notna(), None)

    return run(c)


def answers(messages: Column) -> Column:
    """Of an array of messages those of the assistant; filtered before they are exploded."""
    return F.filter(messages, lambda m: m["role"] == "assistant")
