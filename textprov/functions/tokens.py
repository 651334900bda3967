"""Tokens and token n-grams as column expressions, and a byte-pair tokenizer as an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space, in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ngrams(tokens: Column, sizes: Sequence[int]) -> Column:
    """All windows of the sizes given; sizes of 0 or above the number of tokens give none."""
    def windows(n: int) -> Column:
        return F.when(
            F.size(tokens) >= n,
            F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n)),
        ).otherwise(F.transform(F.slice(tokens, 1, 0), lambda x: F.array(x)))

    return F.flatten(F.array(*(windows(n) for n in sizes if n > 0)))


def bpe(ranks_path: str, pattern: str):
    """A function from text to token ids; strings of special tokens are ordinary text."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks_path, pattern)
        for texts in batches:
            yield pd.Series(encoding.encode_ordinary_batch(texts.fillna("").tolist(), num_threads=1))

    return encode


#: Bytes of texts that ``bpe_rows`` encodes at once.
ENCODED = 1 << 20


def bpe_rows(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and tokens of ``rows`` (doc_id, text), as ``bpe`` has them; a worker holds the ids of a few texts as Python objects, not those of a whole batch."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path, pattern)
        for batch in batches:
            sizes = np.nan_to_num(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)).astype(np.int64)
            ends, lo = np.cumsum(sizes), 0
            while lo < len(ends):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + ENCODED, "right")))
                found = [np.array(encoding.encode_ordinary(x or ""), np.int32) for x in batch["text"].slice(lo, hi - lo).to_pylist()]
                offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), tokens], names=["doc_id", "tokens"])
                lo = hi

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tokens array<int>")


def unbpe(ranks_path: str, pattern: str):
    """The text of token ids; '' where they aren't valid UTF-8."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks_path, pattern)

        def one(ids) -> str:
            try:
                return encoding.decode_bytes(list(ids)).decode()
            except UnicodeDecodeError:
                return ""

        for found in batches:
            yield found.map(one)

    return decode


_encodings: dict = {}


def _encoding(ranks_path: str, pattern: str):
    import base64

    import tiktoken

    if ranks_path not in _encodings:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[ranks_path] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[ranks_path]


def chunks(tokens: Column, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping windows of ``size`` tokens that cover all; the whole if it fits one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")
    step = size - overlap
    n = F.when(F.size(tokens) <= size, F.lit(1)).otherwise(F.ceil((F.size(tokens) - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * step + 1, size))
