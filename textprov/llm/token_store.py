"""Token ids of a corpus in binary shards, in ascending doc_id order, and their reader.

Documents are tokenised where they are read, and only packed ids are shuffled: once, by ranges of
doc_id whose bounds come from a scan of that column alone. Each task streams its sorted documents
into one shard file of patched frame-of-reference blocks (``pfor``), so it holds a few blocks of ids
and twelve bytes a document. A shard is written under a name of its own and then renamed: a task
that runs again replaces it by the same bytes.

Shard: ``MAGIC``, blocks, doc_ids (i64, NULL_ID for null), lengths (i64), block starts (u64), then
the footer: documents, ids, blocks (u64 each), MAGIC.

Defined results: null text counts as empty, so the document is the end id alone; null ids sort first;
rows that share an id are ordered by their ids' bytes, each a document of its own; an empty table
writes no shard; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pfor, shared, textscan, wordcache
from .shared import place

MAGIC = b"TPPFOR01"
FOOTER = struct.Struct("<QQQ8s")
NULL_ID = -(2**63)
#: Ids held before blocks are written, or decoded at once.
FLUSH = 256 * pfor.BLOCK


class ShardWriter:
    def __init__(self, folder: str, shard: int):
        self.fs, at = place(folder)
        self.path, self.tmp = f"{at}/shard-{shard:06d}.tok", f"{at}/_{uuid.uuid4().hex}"
        self.fs.create_dir(at, recursive=True)
        self.out = self.fs.open_output_stream(self.tmp)
        self.out.write(MAGIC)
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.ids, self.sizes, self.starts, self.tokens = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.tokens += len(ids)
        if self.n_held >= FLUSH:
            self._flush(self.n_held // pfor.BLOCK * pfor.BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for block in pfor.encode_blocks(ids[:count]):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.held, self.n_held = [ids[count:]], len(ids) - count

    def close(self) -> tuple[str, int, int]:
        self._flush(self.n_held)
        for values, kind in ((self.ids, "<i8"), (self.sizes, "<i8"), (self.starts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(FOOTER.pack(len(self.ids), self.tokens, len(self.starts), MAGIC))
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return self.path, len(self.ids), self.tokens


class ShardReader:
    """Documents of one shard; ``document(i)`` reads only the blocks that hold it."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        docs, self.tokens, blocks, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.index = size - FOOTER.size - 16 * docs - 8 * blocks
        raw = self.file.read_at(16 * docs + 8 * blocks, self.index)
        self.doc_ids, self.sizes = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<i8", docs, 8 * docs)
        self.starts = np.append(np.frombuffer(raw, "<u8", blocks, 16 * docs).astype(np.int64), self.index)
        self.first = np.append(0, np.cumsum(self.sizes))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` to ``end`` of the shard."""
        if end <= begin:
            return np.empty(0, np.uint32)
        lo, hi = begin // pfor.BLOCK, -(-end // pfor.BLOCK)
        base = int(self.starts[lo])
        raw = memoryview(self.file.read_at(int(self.starts[hi]) - base, base))
        out = np.concatenate([pfor.decode_block(raw[int(self.starts[b]) - base : int(self.starts[b + 1]) - base]) for b in range(lo, hi)])
        return out[begin - lo * pfor.BLOCK : end - lo * pfor.BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.first[i]), int(self.first[i + 1]))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Number and ids of each document, read a run of blocks at a time."""
        lo, n = 0, len(self.sizes)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + FLUSH, "right")) - 1)
            ids = self.ids(int(self.first[lo]), int(self.first[hi]))
            for i in range(lo, hi):
                yield i, ids[self.first[i] - self.first[lo] : self.first[i + 1] - self.first[lo]]
            lo = hi


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text); the manifest: shard, path, n_docs, n_tokens, start (ids in the shards before)."""
    shared.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shards = shards or shared.parts(spark)
    at = [i / shards for i in range(1, shards)] or [0.5]
    bounds = docs.select(F.percentile_approx("doc_id", at, 100 * shards).alias("b")).first()["b"] or []
    bounds = np.array(sorted(set(bounds)), np.int64)[: shards - 1]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordcache.encoder(tokenizer)
        for batch in batches:
            ids_all = batch["doc_id"].cast(pa.int64())
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                ids, counts = encoder.ids(data, offsets)
                # the end id goes behind each document's ids
                ids = np.insert(ids, np.cumsum(counts), end_id)
                small = bool(len(ids) == 0 or ids.max() < 1 << 16)
                raw = ids.astype("<u2" if small else "<u4")
                ends = np.append(0, np.cumsum(counts + 1)) * raw.itemsize
                doc_ids = ids_all.slice(lo, hi - lo)
                shard = np.searchsorted(bounds, doc_ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False), "right")
                packed = pa.Array.from_buffers(
                    pa.large_binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), doc_ids, pa.array(np.full(hi - lo, small)), packed],
                    names=["shard", "doc_id", "small", "ids"],
                )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = current = None
        done = []
        for batch in batches:
            for shard, doc_id, small, ids in zip(*(batch[c] for c in ("shard", "doc_id", "small", "ids"))):
                if shard.as_py() != current:
                    done += [(current, *writer.close())] if writer else []
                    current = shard.as_py()
                    writer = ShardWriter(folder, current)
                writer.add(doc_id.as_py(), np.frombuffer(ids.as_buffer(), "<u2" if small.as_py() else "<u4").astype(np.uint32))
        done += [(current, *writer.close())] if writer else []
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["shard", "path", "n_docs", "n_tokens"],
            )

    rows = docs.select("doc_id", "text").mapInArrow(tokenise, "shard int, doc_id long, small boolean, ids binary")
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "ids")
    # one row a shard
    made = rows.mapInArrow(store, "shard int, path string, n_docs long, n_tokens long").collect()
    for left in shared.place(folder)[0].get_file_info(pafs.FileSelector(shared.place(folder)[1], allow_not_found=True)):
        if left.base_name.startswith("_"):  # of attempts that failed
            shared.place(folder)[0].delete_file(left.path)
    start, manifest = 0, []
    for shard, path, n_docs, n_tokens in sorted(made):
        manifest.append((shard, path, n_docs, n_tokens, start))
        start += n_tokens
    manifest = spark.createDataFrame(manifest, "shard int, path string, n_docs long, n_tokens long, start long")
    return manifest.repartition(max(1, len(made)), "shard") if made else manifest


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = place(folder)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                shard = ShardReader(fs, path)
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in shard.documents()), np.int64, len(shard.sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, mask=shard.doc_ids == NULL_ID),
                        pa.array(shard.first[:-1].astype(np.int64) + start),
                        pa.array(shard.sizes.astype(np.int64)),
                        pa.array(crc),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return manifest.select("path", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared.new_folder(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1), folder)
