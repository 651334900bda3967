"""Token ids of whole texts by the tokenizers library, each distinct piece of a batch encoded once.

Texts are cut only where the tokenizer always starts a new pre-token, so the ids of the pieces in
order are the ids of the text:

* white space kept (byte-level regex, no normaliser): before a 0x20 with no white space on either
  side. Every alternative of the pattern that takes white space after something else starts at it.
* white space dropped (the pre-tokenizer removes it): at any run of 0x20 and 0x09-0x0D. No
  normalisation, pattern or special token reaches over those.

For tokenizers of any other kind, whole texts are encoded.
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import textscan

#: Bounds of the cache, and pieces encoded as one text.
MAX_WORDS, MAX_IDS, RUN = 600_000, 4_000_000, 256

_encoders: dict[str, Encoder] = {}


def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def kind_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    added = spec.get("added_tokens") or []
    if any(set(" \t\n\r\v\f") & set(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "kept"
    first = (pre.get("pretokenizers") or [{}])[0]
    norms = {n["type"] for n in (norm or {}).get("normalizers", [])}
    if norms <= {"NFC", "Replace", "Lowercase"} and first.get("behavior") == "Removed" and first.get("invert"):
        return "dropped"
    return "whole"


def wide_spaces(data: np.ndarray) -> np.ndarray:
    """Marks every byte of white space, ASCII or not."""
    space = textscan.SPACE[data]
    n = len(data)
    for at in (np.flatnonzero(data == 0xC2),):
        at = at[at + 1 < n]
        at = at[np.isin(data[at + 1], (0x85, 0xA0))]
        space[at] = space[at + 1] = True
    at = np.flatnonzero((data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    at = at[at + 2 < n]
    b0, b1, b2 = data[at], data[at + 1], data[at + 2]
    hit = (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)
    hit |= (b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))
    hit |= (b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)
    hit |= (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    at = at[hit]
    space[at] = space[at + 1] = space[at + 2] = True
    return space


class Encoder:
    """Encodes blocks of texts; pieces are known by 64-bit hash (two of a full cache are alike once in 10^8 caches)."""

    def __init__(self, path: str):
        self.lib, self.kind = library(path), kind_of(path)
        added = self.lib.get_added_tokens_decoder()
        names = self.lib.get_vocab(with_added_tokens=True)
        #: Bytes of text that each id stands for.
        self.width = np.zeros(max(names.values(), default=0) + 1, np.int64)
        for name, i in names.items():
            self.width[i] = len(added[i].content.encode()) if i in added else len(name.removesuffix("</w>"))
        self.reset()

    def reset(self) -> None:
        self.known, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.start, self.size, self.uses = np.empty(0, np.uint32), *(np.empty(0, np.int64) for _ in range(3))

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each piece, whether it may be encoded behind and before others, and pieces by text."""
        if self.kind == "dropped":
            words = textscan.Words(data, offsets)
            # the normaliser keeps the width of ASCII alone, and widths prove the seams
            wide = np.append(0, np.cumsum(data >= 0x80))
            return words.starts, words.ends, wide[words.starts] == wide[words.ends], words.counts
        starts = offsets[:-1]
        if self.kind == "kept":
            space = np.ones(len(data) + 2, bool)
            space[1:-1] = wide_spaces(data)
            cut = (data == 0x20) & ~space[:-2] & ~space[2:]
            cut[offsets[:-1][offsets[:-1] < len(data)]] = False
            last = offsets[1:] - 1
            cut[last[last >= 0]] = False
            starts = np.sort(np.concatenate([offsets[:-1], np.flatnonzero(cut)]))
        ends = np.append(starts[1:], len(data))
        joins = np.zeros(len(starts), bool)
        if self.kind == "kept" and len(data):
            at = np.minimum(starts, len(data) - 1)
            joins = (ends - starts > 1) & (data[at] == 0x20) & ~space[at + 2] & ~space[ends]
        return starts, ends, joins, np.diff(np.searchsorted(starts, offsets, "left"))

    def _encode(self, words: list[bytes], joins: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. Runs of pieces are encoded as one text where the ids' widths prove the seams."""
        glue = b" " if self.kind == "dropped" else b""
        together = [i for i, ok in enumerate(joins) if ok]
        groups = [together[i : i + RUN] for i in range(0, len(together), RUN)]
        found: list[np.ndarray | None] = [None] * len(words)
        texts = [glue.join(words[i] for i in g).decode("utf-8", "replace") for g in groups]
        for group, e in zip(groups, self.lib.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends, done = np.cumsum([len(words[i]) for i in group]), np.cumsum(self.width[ids])
            at = np.searchsorted(done, ends)
            if len(ids) and at[-1] == len(ids) - 1 and (done[np.minimum(at, len(ids) - 1)] == ends).all():
                cuts = [0, *(at + 1).tolist()]
                for i, a, b in zip(group, cuts, cuts[1:]):
                    found[i] = ids[a:b]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.lib.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)):
            found[i] = np.array(e.ids, np.uint32)
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), np.fromiter(map(len, found), np.int64, len(found))

    def _texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces, and pieces by text."""
        starts, ends, joins, counts = self.pieces(data, offsets)
        unique, where, back, times = np.unique(textscan.hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.known, unique)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            raw, mine = data.tobytes(), where[new]
            ids, size = self._encode([raw[a:b] for a, b in zip(starts[mine].tolist(), ends[mine].tolist())], joins[mine].tolist())
            self.known = np.insert(self.known, at[new], unique[new])
            self.number = np.insert(self.number, at[new], len(self.size) + np.arange(len(new)))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, ids)
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        numbers = self.number[np.searchsorted(self.known, unique)]
        self.uses[numbers] += times
        return numbers[back], counts

    def _tidy(self) -> None:
        """Past the bound, keep the pieces seen more than once, the most used first; results don't change."""
        if len(self.known) <= MAX_WORDS and len(self.flat) <= MAX_IDS:
            return
        uses = self.uses[self.number]
        stay = np.argsort(-uses, kind="stable")[: MAX_WORDS // 2]
        stay = np.sort(stay[(uses[stay] > 1) & (self.size[self.number[stay]] < 64)])
        number, flat = self.number[stay], self.flat
        size, uses = self.size[number], uses[stay] // 2
        start = np.cumsum(size) - size
        self.known, self.number = self.known[stay], np.arange(len(stay))
        self.flat = flat[np.repeat(self.start[number] - start, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.uses = start, size, uses

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a block, and how many each has."""
        at, counts = self._texts(data, offsets)
        size = self.size[at]
        total = int(size.sum())
        shift = self.start[at] - (np.cumsum(size) - size)
        out = self.flat[np.repeat(shift, size) + np.arange(total)]
        per_text = textscan.cut_sum(size, np.append(0, np.cumsum(counts)))
        self._tidy()
        return out, per_text

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, counts = self._texts(data, offsets)
        out = textscan.cut_sum(self.size[at], np.append(0, np.cumsum(counts)))
        self._tidy()
        return out


def encoder(path: str) -> Encoder:
    """One for each tokenizer and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
