"""Operators against brute force: the whole of sf0.001 with awkward rows added, and the pipeline."""

from collections import Counter
from functools import cache
from pathlib import Path

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textprov.llm import bloom_lm, chat, exact_dedup, importance, minhash, mixing, packing, quality_rules, shared, textscan, token_counts, token_store, wordcache

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LONG = " ".join(f"word{i % 900} İb ẞ naïve" for i in range(9000))
#: Null ids and texts, empty and blank texts, repeated rows, ties, characters whose width the normaliser changes, a very long text.
AWKWARD = [
    (None, "null id, some words here", "en", "src1"), (None, None, None, None), (7000, None, "en", "src1"), (7001, "", "en", None), (7002, " \t\n", None, "src1"),
    (7003, "İb", "de", "src2"), (7004, "ẞ", "de", "src2"), (7005, "same words twice over", "fr", "nowhere"), (7005, "same words twice over", "fr", "nowhere"),
    (7006, "Same Words twice over", "xx", "src3"), (7007, LONG, "en", "src0"), (7008, LONG + " end", "en", "src0"), (7009, "<|endoftext|> \x00   x", "en", "src0"),
]
#: Columns whose names the operators use themselves.
CLASHES = {"file": 1, "row": 2, "__kept": 3, "__copies": 4, "a.b": 5, "_metadata": 6, "value": 7, "kept": 8, "digest": 9, "nr": 10, "score": 11, "cid": 12, "leaf": 13, "x`y": 14}


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    more = spark.createDataFrame(AWKWARD, rows.schema)
    return shared.written(rows.unionByName(more).coalesce(3), "awkward")


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.collect()]


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({k: F.lit(v) for k, v in CLASHES.items() if "`" not in k and "." not in k}).select("*", F.lit(5).alias("a.b"), F.lit(14).alias("x`y"))


def key(row):
    return str(row)


def alike(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


library = cache(wordcache.library)


def ids_of(path, text, end):
    return [*library(path).encode(text or "", add_special_tokens=False).ids, end]


def test_token_store(spark, docs, rows):
    folder = shared.new_folder(spark, "test-store")
    got = token_store.read_documents(token_store.write_shards(docs, folder, WORDS, 1), folder).collect()
    expected = Counter((r[0], len(i), brute.crc(i)) for r in rows for i in [ids_of(WORDS, r[1], 1)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    at, last = 0, float("-inf")
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, float("-inf") if r.doc_id is None else r.doc_id
    # a second writing leaves no files of attempts
    token_store.write_shards(docs, folder, WORDS, 1)
    assert not [p for p in Path(folder.removeprefix("file://")).iterdir() if p.name.startswith("_")]


def test_seams_of_widened_pieces():
    encoder, lib = wordcache.Encoder(WORDS), wordcache.library(WORDS)
    odd = ["İb", "ẞ", "İ", "ß", "ﬁ", "é", "é", "Å", "K", "ab", "B's", "ǅ", "Ω", "ΐ", "日本", "İİ"]
    for a in odd:
        for b in odd:
            import pyarrow as pa

            (_, _, data, offsets), = textscan.blocks(pa.array([f"{a} {b} x", f"{b} {a}"]))
            ids, _ = encoder.ids(data, offsets)
            assert ids.tolist() == [i for t in (f"{a} {b} x", f"{b} {a}") for i in lib.encode(t, add_special_tokens=False).ids]


def test_near(docs, rows):
    got = minhash.near_duplicates(docs)
    expected = brute.near([r[:2] for r in rows])
    alike(got.select("doc_id", "n_shingles", "component_id").collect(), [(r[0], *e) for r, e in zip(rows, expected)])
    assert got.filter("NOT (kept <=> (doc_id <=> component_id))").isEmpty()


def test_texts_that_share_a_passage(spark):
    """Many that share about half and are not linked, with a few linked pairs among them: all links."""
    passage = " ".join(f"p{i}" for i in range(60))
    given = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(50))) for i in range(150)]
    given += [(1000 + i, given[i][1] + f" end{i}") for i in range(0, 150, 30)] + [(2000 + i, " ".join(given[i][1].split()[6:])) for i in range(0, 150, 50)]
    got = minhash.near_duplicates(spark.createDataFrame(given, "doc_id long, text string"))
    expected = brute.near(given)
    alike(got.select("doc_id", "n_shingles", "component_id").collect(), [(g[0], *e) for g, e in zip(given, expected)])
    assert len({e[1] for e in expected}) == 150


def test_exact(spark, docs, rows):
    index = exact_dedup.DigestIndex(spark, shared.new_folder(spark, "test-index"))
    got = index.decide(docs, "one").collect()
    alike([(r.doc_id, r.keep_id, r.group_size) for r in got], [(r[0], *e) for r, e in zip(rows, brute.exact([r[:2] for r in rows]))])
    assert sum(r.kept for r in got) == len({r[1] or "" for r in rows})
    # the same batch again has the same result, another one of the same texts keeps nothing
    alike([r[:5] for r in index.decide(docs, "one").collect()], [r[:5] for r in got])
    assert not any(r.kept for r in index.decide(docs, "two").collect())
    assert index.read().count() == len({r[1] or "" for r in rows})
    # what was appended and not committed doesn't count
    lost = exact_dedup.DigestIndex(spark, shared.new_folder(spark, "test-lost"))
    lost.append(spark.createDataFrame([(bytearray(b"x"), 1)], "digest binary, keep_id long"), "broken")
    for name in lost._named("_commit=*"):
        lost.fs.delete(lost._path(f"{lost.path}/{name}"), False)
    assert lost.read().count() == 0 and sum(r.kept for r in lost.decide(docs, "broken").collect()) == sum(r.kept for r in got)


def test_rules(docs, rows):
    got = quality_rules.measure(docs).collect()
    expected = [(r[0], *brute.base_counts(r[1]), v[2]) for r, v in zip(rows, brute.quality([(r[2], r[1]) for r in rows], quality_rules))]
    alike([(r.doc_id, *(r[c] for c in quality_rules.BASE[:1]), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got], expected)


def test_lm(docs, rows):
    docs = docs.select("*", (F.coalesce(F.col("doc_id"), F.lit(0)) % 3 > 0).alias("train"), F.lit(1).alias("n_known"))
    got = bloom_lm.score(docs, F.col("train"))
    assert got.columns == ["doc_id", "lang", "source", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    expected = brute.lm([r[1] for r in rows], [r[1] for r in rows if (r[0] or 0) % 3 > 0])
    a, b = sorted(got.collect(), key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(zip(rows, expected), key=lambda x: (str(x[0][0]), x[1][0]))
    for r, (row, e) in zip(a, b):
        assert (r.doc_id, r.n_tokens, r.n_known) == (row[0], *e[:2]) and r.base_score == pytest.approx(e[2], rel=1e-9)
    # quantised counts and false positives move the score by little
    assert sum(r.score for r in a) == pytest.approx(sum(e[3] for _, e in b), rel=0.03)
    # learning from a table of the same rows is the same
    other = bloom_lm.score(docs, docs.filter("train"))
    assert {(r.doc_id, r.n_tokens): r.score for r in other.collect()} == pytest.approx({(r.doc_id, r.n_tokens): r.score for r in a})


def test_lm_sums_to_one():
    """Over all that may follow a context, unknown words as one, probabilities sum to 1."""
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.zipf(1.5, 4000) % 50 + 1
    counts = [Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1)) for k in (1, 2, 3)]
    sums = np.zeros((2, bloom_lm.LEVELS + 1))
    for c in counts:
        level = bloom_lm.levels(np.array(list(c.values())))
        np.add.at(sums[0], level, list(c.values()))
        np.add.at(sums[1], level, 1)
    means = np.where(sums[1] > 0, sums[0] / np.maximum(sums[1], 1), 0)
    n, v = len(text), len(counts[0])
    exact = {g: c for k in counts for g, c in k.items()}
    totals = []
    for context in [(1, 1), (1, 2), (2, 1), (3, 1), (9, 1), (1, 40), (77, 78)]:
        total = 0
        for w in [*range(1, 51), 99]:
            grams = [context[:1], context[1:], (w,)]
            pairs, triple = [context, (context[1], w)], (*context, w)
            lv = lambda g: int(bloom_lm.levels(np.array([exact[g]]))[0]) if g in exact else 0
            p = bloom_lm.interpolate(
                np.array([lv(g) for g in grams]), [np.array([0, 1, 1], np.uint64), np.array([0, 0, 1], np.uint64)],
                [np.array([0, *map(lv, pairs)]), np.array([0, 0, lv(triple)])], means, float(n + v + 1), (0.1, 0.3),
            )
            total += p[2]
        # 99 stands for one unknown word, as do the numbers that the text lacks
        totals.append(total - sum(w not in {g[0] for g in counts[0]} for w in range(1, 51)) * p[2])
    assert totals == pytest.approx([1] * len(totals), abs=0.03)


def test_importance(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 150)] + [(None, 1)], "doc_id long, quality int")
    got = importance.resample(docs, labels, labels.quality == 1, k=50).collect()
    assert sum(r.kept for r in got) == 50 and min(r.gumbel_key for r in got if r.kept) >= max(r.gumbel_key for r in got if not r.kept)
    import math
    import re

    import numpy as np

    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")

    def features(text):
        found = [textscan.hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)])) for t in token.findall((text or "").encode().lower())]
        pairs = [textscan.windows(np.concatenate(p), np.zeros(2, int), 2)[0] for p in zip(found, found[1:])]
        return [int(textscan.mix(h)[0] % np.uint64(importance.BUCKETS)) for h in found + pairs]

    raw, target = Counter(), Counter()
    for r in rows:
        f = features(r[1])
        raw.update(f)
        if r[0] is not None and r[0] < 150 and r[0] % 3 == 0:
            target.update(f)
    size = [c.total() + importance.BUCKETS for c in (raw, target)]
    weights = [(str(r[0]), sum(math.log((target[x] + 1) / size[1]) - math.log((raw[x] + 1) / size[0]) for x in features(r[1]))) for r in rows if len(r[1] or "") < 10_000]
    ours = sorted((str(r.doc_id), r.log_weight) for r in got)
    for k, w in weights:
        assert any(k == a and w == pytest.approx(b, abs=1e-6) for a, b in ours)
    # parts without a token
    assert importance.resample(docs.filter(~F.coalesce("text", F.lit("")).rlike(r"\S")), labels, labels.quality == 1).count() == 4


def test_importance_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    got = importance.resample(docs, labels.filter(~out), F.col("quality") == 1).join(labels.filter(out), "doc_id").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert len(good) > 50 and sum(good) > 0.95 * len(good) and len(bad) > 10 and sum(bad) < 0.2 * len(bad)


def test_packing(docs, rows):
    got = packing.pack(docs, BYTES, 2).collect()
    expected = [(r[0], i, a, len(x), brute.crc(x)) for r in rows for i, a, x in brute.pieces(ids_of(BYTES, r[1], 2), 1024)]
    alike([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], expected)
    n, least = brute.packed_well(got, 1024)
    assert n <= 1.03 * least + 1


def test_complements():
    index = packing.Complements([0, 2, 0, 1, 0, 1, 0, 0])
    assert index.exact(5) == (5,) and index.exact(8) == (5, 3) and index.exact(7) == (5, 1, 1) and index.exact(9) == (5, 3, 1) and index.exact(4) == (3, 1)
    index.left[5] = 0
    assert index.exact(5) == (3, 1, 1) and index.exact(8) is None and index.exact(6) is None
    index.left[1] = 1
    assert index.exact(5) is None and index.exact(2) is None and index.best(7) == 3
    assert packing.plan([0] * 5, 4) == []


def test_token_counts(docs, rows):
    got = token_counts.count_tokens(docs, BYTES)
    alike([r[:3] for r in got.collect()], [(r[0], len((r[1] or "").encode()), len(ids_of(BYTES, r[1], 0)) - 1) for r in rows])


def test_resynchronised_counts_of_odd_texts():
    import random

    lib, rng = wordcache.library(BYTES), random.Random(5)
    for chunk, overlap in ((40, 8), (64, 20), (200, 16)):
        for _ in range(60):
            text = "".join(rng.choice(["a", " ", "  ", "\n", "x" * 50, "ab'll ", "日", "é", "123456", "<|endoftext|>", "!?", " "]) for _ in range(rng.randrange(10, 400)))
            assert token_counts.LongCounter(lib, chunk, overlap).count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def placed(docs):
    docs, file, row = shared.located(docs)
    return docs.select("doc_id", "lang", "source", "text", file.alias("f"), row.alias("r")).collect()


def test_mixing(docs):
    rows = placed(docs)
    given = [(r.doc_id, r.lang, r.source, len(ids_of(BYTES, r.text, 0)) - 1, (r.f, r.r)) for r in rows]
    share = 1.9  # test_pipeline has the usual one
    got = mixing.shares(docs, BYTES, mixing.WEIGHTS, mixing.DOMAINS, share=share).collect()
    alike([(r.doc_id, r.source, r.n_tokens, r.copies) for r in got], [(g[0], g[2] or "", g[3], c) for g, c in zip(given, brute.mixing(given, mixing, share))])
    assert mixing.shares(docs.limit(0), BYTES).count() == 0


def test_columns_of_any_name_are_passed_on(spark, clashing, rows):
    index = exact_dedup.DigestIndex(spark, shared.new_folder(spark, "test-clash"))
    kept = {
        "quality": quality_rules.keep(clashing),
        "exact": exact_dedup.keep(clashing, index),
        "near": minhash.keep(clashing),
        "mixed": mixing.mix(clashing, BYTES),
    }
    for name, out in kept.items():
        assert out.columns == clashing.columns, name
        found = out.collect()
        assert found and all(tuple(r)[4:] == tuple(CLASHES[c] for c in clashing.columns[4:]) for r in found), name
    alike([tuple(r)[:2] for r in kept["exact"].collect()], kept_exactly(rows))


def kept_exactly(rows):
    """(id, text) of the row of largest id of each text, null ids lowest."""
    last = {}
    for k, text, *_ in rows:
        rank = (k is not None, k or 0)
        if (text or "") not in last or rank > last[text or ""][0]:
            last[text or ""] = (rank, (k, text))
    return [x for _, x in last.values()]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], docs.schema)
    folder = shared.new_folder(spark, "test-none")
    assert token_counts.count_tokens(none, BYTES).count() == 0
    assert token_store.read_documents(token_store.write_shards(none, folder, WORDS, 1), folder).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert importance.resample(none, labels, labels.quality == 1).count() == 0
    assert {r.kept for r in importance.resample(docs, labels.limit(0), labels.quality == 1).collect()} == {True}
    chat.write(chat.fold(chat.events(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))), folder + "-chat")
    assert chat.read_back(spark, folder + "-chat").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs.limit(0), SF)
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_pipeline(spark, docs):
    """run()'s stages on the awkward table, each against brute force on what its predecessor kept."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = shared.written(stage(spark, now, SF), name)
        before, after = placed(now), [tuple(r) for r in out.collect()]
        whole = [(r.doc_id, r.text, r.lang, r.source) for r in before]
        if name == "quality_rules":
            expected = [w for w, v in zip(whole, brute.quality([(w[2], w[1]) for w in whole], quality_rules)) if v[2]]
        elif name == "exact_dedup":
            expected = [w for w in whole if w[:2] in set(kept_exactly(whole))]
            assert len({w[1] for w in expected}) == len(expected)
        elif name == "near_dedup":
            expected = [w for w, (_, c) in zip(whole, brute.near([w[:2] for w in whole])) if w[0] == c]
        elif name == "mixing":
            given = [(r.doc_id, r.lang, r.source, len(ids_of(BYTES, r.text, 0)) - 1, (r.f, r.r)) for r in before]
            expected = [w for w, c in zip(whole, brute.mixing(given, mixing)) for _ in range(c)]
        else:
            expected = [(w[0], i, a, len(x), brute.crc(x)) for w in whole for i, a, x in brute.pieces(ids_of(BYTES, w[1], 2), 1024)]
            n, least = brute.packed_well(out.collect(), 1024)
            assert n <= 1.05 * least + 2
            after = [r[:5] for r in after]
        alike(after, expected)
        now = out
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "piece", "start"]
