"""Token counts of whole texts, huge documents by overlapping chunks that are resynchronised.

Ordinary texts are counted by ``wordcache``. A text over ``long_bytes`` is encoded in chunks that
overlap. A pre-token boundary is stable where both chunks have it and the left one is proven there:
the matcher looks only forward from a boundary, so both go on alike from it, provided that the left
chunk saw past it by more than the longest special token. Counts are spliced at the first such place.
Where an overlap has none, it is doubled and the left chunk encoded anew, up to the end of the text.

Defined results: null text counts as empty (0 bytes, 0 tokens, not over the limit); null ids and
repeated rows give one row each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import shared, textscan, wordcache

LONG_BYTES, CHUNK, OVERLAP = 1 << 14, 1 << 13, 1 << 8


class LongCounter:
    def __init__(self, lib, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.lib, self.chunk, self.overlap = lib, chunk, overlap
        self.margin = 1 + max([1, *(len(t.content) for t in lib.get_added_tokens_decoder().values())])
        self.widened = 0

    def boundaries(self, text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of text[lo:hi]: where each token starts, and for each whether it starts a pre-token."""
        e = self.lib.encode(text[lo:hi], add_special_tokens=False)
        at = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.ids)) + lo
        word = np.fromiter((-1 if w is None else w for w in e.word_ids), np.int64, len(e.ids))
        new = np.ones(len(at), bool)
        new[1:] = (word[1:] != word[:-1]) & (at[1:] > at[:-1])
        return at, new

    def count(self, text: str) -> int:
        n, total, lo, proven = len(text), 0, 0, 0
        hi = min(n, self.chunk)
        left = self.boundaries(text, lo, hi)
        while hi < n:
            overlap = min(self.overlap, (hi - lo) // 2)
            begin = hi - overlap
            stop = min(n, begin + self.chunk)
            right = self.boundaries(text, begin, stop)
            while True:
                common = np.intersect1d(left[0][left[1]], right[0][right[1]])
                common = common[(common >= max(begin, proven)) & (common <= hi - self.margin)]
                if len(common) or hi == n:
                    break
                self.widened += 1
                overlap *= 2
                hi = min(n, begin + overlap)
                left = self.boundaries(text, lo, hi)
                if stop < hi:
                    stop = min(n, hi + self.chunk)
                    right = self.boundaries(text, begin, stop)
            if not len(common):
                break
            at = int(common[0])
            total += int(((left[0] >= proven) & (left[0] < at)).sum())
            lo, hi, proven, left = begin, stop, at, right
        return total + int((left[0] >= proven).sum())


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; one pass, no shuffle.

    ``tokenizer``: path of a tokenizers file; its own kind decides how ordinary texts are cut.
    Resynchronising is used only with a byte-level regex tokenizer; others encode whole texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordcache.encoder(tokenizer)
        long = LongCounter(encoder.lib) if encoder.kind == "kept" else None
        for batch in batches:
            sizes, counts = [], []
            for _, _, data, offsets in textscan.blocks(batch["text"]):
                size = np.diff(offsets)
                if len(size) == 1 and size[0] > long_bytes and long:
                    found = np.array([long.count(data.tobytes().decode("utf-8", "replace"))])
                elif long and (size > long_bytes).any():
                    found = np.zeros(len(size), np.int64)
                    for i in np.flatnonzero(size > long_bytes):
                        found[i] = long.count(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                    few = np.flatnonzero(size <= long_bytes)
                    if len(few):
                        rest = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in few])
                        found[few] = encoder.counts(rest, np.append(0, np.cumsum(size[few])))
                else:
                    found = encoder.counts(data, offsets)
                sizes.append(size)
                counts.append(found)
            if not sizes:
                continue
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(np.concatenate(sizes)), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    shared.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
