"""Quality rules: base counts, and divergence from language references by Jensen-Shannon distance.

The references are histograms over all documents that pass the base rules: by language, of character
classes and of common words (each makes up at least COMMON of the language's words, so there are at
most 1/COMMON of them). In the first pass a task sends the words that make up COMMON / 2 of what it reads, with
their counts, which are added up: at most 2/COMMON words of a language can be common, whatever the number
of tasks. The second pass counts those exactly; no vocabulary is shuffled. A language has a reference when it has REFERENCE words, whatever its
share, or LANGUAGE of all words. Documents of other languages have nothing to be held against and are
judged by the base rules alone; those without a language are held against the nearest reference.

A document is rejected when a distance is above its bound plus ``noise``, what sampling that many
words would bring. Documents shorter than MIN_WORDS words are judged by the base rules alone.

Defined results: null text counts as no text and fails the base rules; null ids and repeated rows are
judged each for itself; without any reference only the base rules decide; an empty table gives no
rows. ``keep`` passes on all columns, whatever they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, textscan

COMMON, LANGUAGE = 1 / 500, 1 / 1000
#: Words from which on a language's histograms are stable: its least common words come 40 times.
REFERENCE = 20_000
MIN_WORDS, CHAR_BOUND, WORD_BOUND = 30, 0.23, 0.22

CLASSES = 13
CLASS = np.full(256, 12, np.int64)
CLASS[0x80:0xC0] = -1  # continuation bytes are no characters
CLASS[0xC0:0xE0], CLASS[0xE0:0xF0], CLASS[0xF0:] = 9, 10, 11
for _chars, _class in ((b"aeiouy", 0), (b"bcdfghjklmnpqrstvwxz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t", 4), (b"\n\r\v\f", 5), (b".,;:!?", 6), (b"'\"()-[]", 7), (b"#*$%&|<>+/=@\\^_`{}~", 8)):
    CLASS[list(_chars)] = _class
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measures:
    """The base counts of the texts of a block, the words' hashes, and character-class histograms."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        words = textscan.Words(data, offsets)
        raw = words.hashes()
        h, at = textscan.windows(raw, words.text, 5)
        repeat = np.zeros(len(raw) + 1, np.int64)
        if len(h):
            order = np.lexsort((h, words.text[at]))
            hs, ts = h[order], words.text[at][order]
            same = (hs[1:] == hs[:-1]) & (ts[1:] == ts[:-1])
            twice = np.zeros(len(h), bool)
            twice[1:] |= same
            twice[:-1] |= same
            first = at[order[twice]]
            np.add.at(repeat, first, 1)
            np.add.at(repeat, first + 5, -1)
        self.n_words = words.counts.astype(np.int64)
        self.word_chars = textscan.cut_sum(words.is_word & ((data & 0xC0) != 0x80), offsets)
        self.n_symbols = textscan.cut_sum(SYMBOL[data], offsets)
        self.n_repeat_words = textscan.cut_sum(np.cumsum(repeat)[:-1] > 0, words.first)
        self.n_dup_lines = np.zeros(n, np.int64)
        text = data.tobytes()
        lines = textscan.cut_sum(data == 0x0A, offsets)
        for i in np.flatnonzero(lines).tolist():
            found = [x for x in text[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip()]
            self.n_dup_lines[i] = len(found) - len(set(found))
        self.base_failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)
        kind = CLASS[data]
        place = np.repeat(np.arange(n), np.diff(offsets))
        counted = kind >= 0
        self.classes = np.bincount((place * CLASSES + kind)[counted], minlength=n * CLASSES).reshape(n, CLASSES)
        lower = textscan.Words(data, offsets, lower=True)
        self.text, self.hashes = lower.text, lower.hashes()


class Tally:
    """Counts by hash, merged now and then so that it holds about as much as there are distinct hashes."""

    def __init__(self) -> None:
        self.keys, self.counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        self.rows, self.size = 0, 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.rows += len(keys)
        if self.rows > 2 * self.size + 500_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = [keys[at]], [np.add.reduceat(counts, at) if len(at) else counts]
        self.rows = self.size = len(at)
        return self.keys[0], self.counts[0]


def _languages(batch: pa.RecordBatch, lo: int, hi: int) -> list[str | None]:
    return batch["lang"].slice(lo, hi - lo).to_pylist()


def references(docs: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """By language: ``classes`` and ``words`` (shares, the last one that of all other words), ``hashes`` (sorted).

    At most 1/LANGUAGE languages and one for each REFERENCE words reach the driver, with 2/COMMON words of each.
    """
    shared.small_batches(docs.sparkSession)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str | None, Tally] = defaultdict(Tally)
        words: dict[str | None, int] = defaultdict(int)
        for batch in batches:
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                m, langs = Measures(data, offsets), _languages(batch, lo, hi)
                names = list(dict.fromkeys(langs))
                code = np.array([names.index(x) for x in langs])
                code[m.base_failed] = -1
                for k, name in enumerate(names):
                    mine = m.hashes[code[m.text] == k]
                    if len(mine):
                        tallies[name].add(mine)
                        words[name] += len(mine)
        for name, tally in tallies.items():
            keys, counts = tally.merge()
            often = counts >= COMMON / 2 * words[name]
            n = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (n + 1), pa.string()), pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(counts[often], 0)), pa.array([0] * n + [words[name]], pa.int64())],
                names=["lang", "hash", "n", "words"],
            )

    found = shared.written(texts.mapInArrow(candidates, "lang string, hash long, n long, words long"), "candidates")
    total = found.agg(F.sum("words")).first()[0] or 0
    sizes = found.groupBy("lang").agg(F.sum("words").alias("of")).filter((F.col("of") > 0) & (F.col("of") >= min(REFERENCE, total * LANGUAGE)) & F.col("lang").isNotNull())
    big = [r["lang"] for r in sizes.collect()]
    # tasks that left a word out had less than COMMON / 2 of it each, so half of a common word's count is here at least,
    # and no more than 2 / COMMON words can have that much
    sums = found.filter("words = 0").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
    rows = sums.join(F.broadcast(sizes), "lang").filter(F.col("n") >= COMMON / 2 * F.col("of"))
    got = {r["lang"]: r["hashes"] for r in rows.groupBy("lang").agg(F.collect_list("hash").alias("hashes")).collect()}
    likely = {x: np.sort(np.array(got.get(x, []), np.int64).view(np.uint64)) for x in big}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {x: np.zeros(len(k) + 1, np.int64) for x, k in likely.items()}
        classes = {x: np.zeros(CLASSES, np.int64) for x in likely}
        for batch in batches:
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                m, langs = Measures(data, offsets), np.array(_languages(batch, lo, hi), object)
                for x in set(langs) & likely.keys():
                    keys, mine = likely[x], (langs == x) & ~m.base_failed
                    if mine.any():
                        words[x] += np.bincount(lookup(keys, m.hashes[mine[m.text]]), minlength=len(keys) + 1)
                        classes[x] += m.classes[mine].sum(axis=0)
        for x in likely:
            if words[x].any():
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([np.append(classes[x], words[x])])], names=["lang", "counts"])

    # summed by place where they are made; the result has as many rows as candidates
    flat = texts.mapInArrow(count, "lang string, counts array<long>").select("lang", F.posexplode("counts").alias("at", "n"))
    sums = {(r["lang"], r["at"]): r["n"] for r in flat.filter("n > 0").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()}
    out = {}
    for x, keys in likely.items():
        counts = np.array([sums.get((x, i), 0) for i in range(CLASSES + len(keys) + 1)], float)
        classes, words = counts[:CLASSES], counts[CLASSES:]
        if not words.sum():
            continue
        common = np.flatnonzero(words[:-1] >= COMMON * words.sum())
        share = words[common] / words.sum()
        out[x] = {"hashes": keys[common], "words": np.append(share, 1 - share.sum()), "classes": classes / classes.sum()}
    return out


def lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in the sorted ``keys``; len(keys) for those not there."""
    if not len(keys):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, len(keys))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of ``p`` from ``q``."""
    mean = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / mean), 0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def verdicts(m: Measures, langs: list[str | None], refs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances by characters and by words (NaN where not judged), and whether each document stays."""
    n = len(langs)
    chars, words = np.full(n, np.nan), np.full(n, np.nan)
    own = np.array([x if x in refs else None for x in langs], object)
    # a language without a reference has nothing to be far from
    judged = (m.n_words >= MIN_WORDS) & np.array([x is None or x in refs for x in langs], bool)
    p = m.classes / np.maximum(m.classes.sum(axis=1, keepdims=True), 1)
    for name, ref in refs.items():
        mine = np.flatnonzero(judged & ((own == name) | np.equal(own, None)))
        if not len(mine):
            continue
        code = np.full(n, -1)
        code[mine] = np.arange(len(mine))
        k = len(ref["hashes"]) + 1
        at = code[m.text]
        hist = np.bincount(at[at >= 0] * k + lookup(ref["hashes"], m.hashes[at >= 0]), minlength=len(mine) * k).reshape(len(mine), k)
        by_words = distance(hist / np.maximum(hist.sum(axis=1, keepdims=True), 1), ref["words"])
        by_chars = distance(p[mine], ref["classes"])
        nearer = np.isnan(words[mine]) | (by_words + by_chars < words[mine] + chars[mine])
        chars[mine[nearer]], words[mine[nearer]] = by_chars[nearer], by_words[nearer]
    noise = np.sqrt(4 / np.maximum(m.n_words, 1))
    with np.errstate(invalid="ignore"):
        far = (chars > CHAR_BOUND + 0.5 * noise) | (words > WORD_BOUND + noise)
    return chars, words, ~m.base_failed & ~far


def measure(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance and word_distance of each row."""
    refs = references(docs) if refs is None else refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                m = Measures(data, offsets)
                chars, words, kept = verdicts(m, _languages(batch, lo, hi), refs)
                columns = [batch["doc_id"].slice(lo, hi - lo), *(pa.array(getattr(m, c).astype(np.int64)) for c in BASE)]
                columns += [pa.array(m.base_failed), pa.array(kept), pa.array(chars, from_pandas=True), pa.array(words, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "kept", "char_distance", "word_distance"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, f"{schema}, base_failed boolean, kept boolean, char_distance double, word_distance double")


def keep(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, all columns; rows are filtered where they are read."""
    refs = references(docs) if refs is None else refs
    texts, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textscan.blocks(batch.column(texts)):
                langs = batch.column(lang).slice(lo, hi - lo).to_pylist()
                _, _, kept = verdicts(Measures(data, offsets), langs, refs)
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    # mapInArrow can't look up columns of every name
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measure(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The character classes but the last, which has the rest.
_CLASSES = ("[aeiouy]", "[bcdfghjklmnpqrstvwxz]", "[A-Z]", "[0-9]", r"[ \t]", r"[\n\r\x0B\f]", "[.,;:!?]", r"[\x27\x22()\-\[\]]", r"[#*$%&|<>+/=@\\^_`{}~]", r"[\x{80}-\x{7FF}]", r"[\x{800}-\x{FFFF}]", r"[\x{10000}-\x{10FFFF}]")
_PER_CLASS = ", ".join(f"len(regexp_extract_all(s, '{c}'))" for c in _CLASSES)


def _half(p: str, q: str) -> str:
    return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, s, t, len(t) AS n_words, list_transform(string_split(s, chr(10)), lambda x: CASE WHEN regexp_matches(x, {_WORD}) THEN x END) AS lines
  FROM (SELECT doc_id, lang, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), {_WORD}) AS t FROM documents)
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(t[i:i + 4], ' ')) AS c FROM (SELECT doc_id, t, unnest(range(1, n_words - 3)) AS i FROM d WHERE n_words >= 5)
), repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(5) r(k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, lang, s, t, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(s, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(lines, lambda x: x IS NOT NULL)) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n, 0) > 20 * n_words AS base_failed
  FROM d LEFT JOIN repeated USING (doc_id)
), w AS (SELECT doc_id, lang, base_failed, n_words, unnest(regexp_extract_all(translate(s, '{_UPPER}', '{_LOWER}'), {_WORD})) AS word FROM m),
c AS (SELECT doc_id, lang, base_failed, unnest(range(13)) AS k, unnest(list_append(x, length(s) - list_sum(x))) AS n FROM (SELECT *, [{_PER_CLASS}] AS x FROM m)),
total AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS n_all FROM w WHERE NOT base_failed GROUP BY lang),
big AS (SELECT lang, n FROM total WHERE lang IS NOT NULL AND n >= least({REFERENCE}, n_all * {LANGUAGE})),
common AS (SELECT w.lang, word, count(*) / any_value(big.n) AS q FROM w JOIN big ON w.lang = big.lang WHERE NOT base_failed GROUP BY w.lang, word HAVING count(*) >= {COMMON} * any_value(big.n)),
others AS (SELECT lang, 1 - coalesce(sum(q), 0) AS q FROM big LEFT JOIN common USING (lang) GROUP BY lang),
classes AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM c WHERE NOT base_failed GROUP BY lang, k),
judged AS (SELECT m.doc_id, big.lang AS ref, m.n_words FROM m JOIN big ON m.lang = big.lang OR m.lang IS NULL WHERE m.n_words >= {MIN_WORDS}),
by_word AS (
  SELECT doc_id, ref, sum({_half("p", "q")} - q) AS found, sum(p) AS p
  FROM (SELECT j.doc_id, ref, common.word, count(*) / any_value(j.n_words) AS p, any_value(q) AS q FROM judged j JOIN w USING (doc_id) JOIN common ON common.lang = ref AND common.word = w.word GROUP BY ALL)
  GROUP BY ALL
), far_words AS (
  SELECT j.doc_id, ref, sqrt(greatest(0, (coalesce(found, 0) + 1 - o.q + {_half("(1 - coalesce(p, 0))", "o.q")}) / 2)) AS word_distance
  FROM judged j JOIN others o ON o.lang = ref LEFT JOIN by_word USING (doc_id, ref)
), far_chars AS (
  SELECT doc_id, ref, sqrt(greatest(0, sum({_half("p", "q")}) / 2)) AS char_distance
  FROM (SELECT j.doc_id, ref, c.k, n / sum(n) OVER (PARTITION BY j.doc_id, ref) AS p, q FROM judged j JOIN c USING (doc_id) JOIN classes ON classes.lang = ref AND classes.k = c.k) GROUP BY ALL
), far AS (
  SELECT doc_id, min_by(char_distance, char_distance + word_distance) AS char_distance, min_by(word_distance, char_distance + word_distance) AS word_distance
  FROM far_words JOIN far_chars USING (doc_id, ref) GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(char_distance > {CHAR_BOUND} + 0.5 * sqrt(4 / n_words) OR word_distance > {WORD_BOUND} + sqrt(4 / n_words), false) AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM m LEFT JOIN far USING (doc_id)
"""
