"""Operators on a small fixture with nulls, empty texts, ties, repeated rows and no rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textprov.llm import bloom_lm, chat, exact_dedup, importance, minhash, mixing, packing, pfor, quality_rules, shared, textscan, token_counts, token_store, wordcache

SCHEMA = "doc_id long, text string, lang string, source string, digest string"
LONG = " ".join(f"word{i}" for i in range(400))
ROWS = [
    (1, LONG, "en", "src0", "x"), (2, LONG + " more", "en", "src0", "x"), (3, LONG, "en", "src1", None), (4, None, None, None, None), (5, "", "en", "src9", "x"),
    (6, "a b", "de", "src0", "x"), (7, "A  b", "de", "src0", "x"), (8, "Z" * 70000 + " end", "fr", "src7", "x"), (9, LONG.replace("1", "x"), "en", "src0", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_near(docs):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in range(1, 10)] == [1, 1, 1, 4, 5, 6, 6, 8, 9]
    assert [got[i].n_shingles for i in (1, 4, 5, 6)] == [396, 0, 0, 1]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_exact(spark, docs):
    index = exact_dedup.DigestIndex(spark, shared.new_folder(spark, "test-index"))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.decide(docs).collect()}
    assert got[1] == (3, 2, False) and got[3] == (3, 2, True) and got[4] == (5, 2, False) and got[6] == (6, 1, True)
    assert not any(r.kept for r in index.decide(docs).collect())
    assert exact_dedup.keep(docs, exact_dedup.DigestIndex(spark, shared.new_folder(spark, "other"))).columns == docs.columns


def test_tokens(spark, docs):
    lib = wordcache.library(path("byte_bpe_50k.json"))
    for r in token_counts.count_tokens(docs, path("byte_bpe_50k.json")).collect():
        text = ROWS[r.doc_id - 1][1] or ""
        assert r.n_tokens == len(lib.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode())
    folder = shared.new_folder(spark, "test-shards")
    rows = token_store.read_documents(token_store.write_shards(docs, folder, path("word_bpe_49k.json"), 1), folder).orderBy("doc_id").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]] and rows[3].n_tokens == 1


def test_pfor():
    values = np.random.default_rng(1).integers(0, 2**32, 5000, dtype=np.uint32)
    values[:3000] %= 97
    assert (np.concatenate([pfor.decode_block(b) for b in pfor.encode_blocks(values)]) == values).all()


def test_packing(docs):
    rows = packing.pack(docs, path("byte_bpe_50k.json"), 2, 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)])[:-1]] and sum(n for _, n in parts) <= 64


def test_lm(docs):
    rows = {r.doc_id: r for r in bloom_lm.score(docs.select("doc_id", "text"), docs).collect()}
    n = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1 for r in ROWS)
    assert rows[4].n_tokens == 1 and rows[1].train_tokens == n and rows[1].n_known == 401
    small = {r.doc_id: r for r in bloom_lm.score(docs.select("doc_id", "text"), docs, max_words=3).collect()}
    assert all(abs(small[i].base_score - rows[i].base_score) < 1e-6 for i in rows)


def test_rules(docs):
    got = {r.doc_id: r for r in quality_rules.measure(docs).collect()}
    assert got[4].base_failed and not got[5].kept and got[1].kept and got[1].n_words == 400


def test_chat(spark):
    for text in (chat.PROBE, "\\<s>\\\\", "<<SYS>>[INST]<</SYS>>", ""):
        assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))
    events = [(1, 0, 0, "user", "hi", None), (1, 1, 1, "assistant", "a", "delta"), (1, 1, 2, "assistant", "b", "delta"), (1, 1, 3, "assistant", "", "regenerate"), (1, 1, 4, "assistant", "c", "delta"), (1, 2, 5, "user", "x", None), (1, 2, 6, "user", "y", "edit")]
    folded = chat.fold(spark.createDataFrame(events, "conv_id long, turn long, seq long, role string, text string, kind string"))
    assert [(r.turn, r.text) for r in folded.orderBy("turn").collect()] == [(0, "hi"), (1, "c"), (2, "y")]
    # a regeneration drops what was said in later turns up to then; an earlier message can be edited any time; a deleted one goes
    log = [
        (1, 0, 0, "user", "q", None), (1, 1, 1, "assistant", "bad ", "delta"), (1, 1, 2, "assistant", "answer", "delta"), (1, 2, 3, "user", "why?", None),
        (1, 3, 4, "assistant", "because", "delta"), (1, 1, 5, "assistant", "", "regenerate"), (1, 1, 6, "assistant", "good", "delta"), (1, 0, 7, "user", "Q", "edit"),
        (1, 2, 8, "user", "thanks", None), (1, 3, 9, "assistant", "", "delete"), (2, 2, 3, "user", "other", None), (None, 0, 1, None, None, None),
    ]
    schema = "conv_id long, turn long, seq long, role string, text string, kind string"
    got = chat.fold(spark.createDataFrame(log, schema).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, "user", "Q"), (1, 1, "assistant", "good"), (1, 2, "user", "thanks"), (2, 2, "user", "other"), (None, 0, "", "")], key=str)
    assert chat.fold(spark.createDataFrame([], schema)).count() == 0
    # messages to events and back: repeated rows, nulls, long texts
    said = [(1, 0, "user", "x" * 1000), (1, 1, "assistant", "é\n" * 700), (1, 1, "assistant", "é\n" * 700), (None, None, None, None), (2, None, "assistant", "")]
    back = chat.fold(chat.events(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(a, b, c or "", d or "") for a, b, c, d in said], key=str)
    folder = shared.new_folder(spark, "test-chat")
    chat.write(folded, folder)
    row = chat.read_back(spark, folder).first()
    assert row.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nc\nuser\ny\n").hexdigest() and row.loss_chars == 1


def test_importance(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 0)], "doc_id long, quality int")
    rows = importance.resample(docs, labels, labels.quality == 1, k=4).collect()
    assert sum(r.kept for r in rows) == 4 and min(r.gumbel_key for r in rows if r.kept) >= max(r.gumbel_key for r in rows if not r.kept)


def test_mixing(docs):
    rows = mixing.shares(docs, path("byte_bpe_50k.json")).collect()
    assert len(rows) == len(ROWS) and sum(r.n_tokens * r.copies for r in rows) <= 0.8 * sum(r.n_tokens for r in rows) + 1
    assert mixing.mix(docs, path("byte_bpe_50k.json")).columns == docs.columns


def test_blocks():
    assert [x[:2] for x in textscan.blocks(pa.array(["a", None, "bb"]), 1)] == [(0, 2), (2, 3)]


def test_lm_filter_grows():
    rng = np.random.default_rng(1)
    for n in (1000, 300_000):
        keys, counts = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)), rng.integers(2, 9, n)
        segment = bloom_lm.Filter.build(keys, counts)
        # bits follow the items, and no n-gram is left out
        assert segment.bits >= bloom_lm.BITS * bloom_lm.levels(counts).sum()
        assert (segment.level(keys) >= bloom_lm.levels(counts)).all()
        assert (segment.level(keys + np.uint64(1)) > 0).mean() < 0.03
        assert (bloom_lm.unpack(bloom_lm.pack(keys)) == keys).all()


def test_lm_runs_do_not_depend_on_batches():
    rows = pa.record_batch({"text": pa.array(["abc", None, "", "x" * 30, "yy"] * 20)})

    def cuts(n):
        return ["|".join(str(x) for b in run for x in b["text"]) for run in bloom_lm.runs((rows.slice(i, n) for i in range(0, 100, n)), 50)]

    assert cuts(100) == cuts(7) == cuts(1) and len(cuts(7)) > 5


def test_lm_spread_documents(docs):
    plain = {r.doc_id: r.score for r in bloom_lm.score(docs.select("doc_id", "text"), docs).collect()}
    spread = {r.doc_id: r.score for r in bloom_lm.score(docs.select("doc_id", "text").repartition(3), docs.repartition(2)).collect()}
    assert spread == pytest.approx(plain)
    assert bloom_lm.score(docs.select("doc_id", "text").limit(0), docs).count() == 0
    assert bloom_lm.score(docs.select("doc_id", "text"), docs.limit(0)).count() == len(ROWS)


def test_lm_phrases_seen_once(spark):
    said = "the quick brown fox jumps over a lazy dog"
    training = spark.createDataFrame([(1, said), (2, " ".join(reversed(said.split())))], "doc_id long, text string")
    held_out = spark.createDataFrame([(1, "quick brown fox"), (2, "brown over dog")], "doc_id long, text string")
    rows = {r.doc_id: r for r in bloom_lm.score(held_out, training).collect()}
    # the same words each seen twice; two bigrams and a trigram of the first were seen once
    assert rows[1].base_score == pytest.approx(rows[2].base_score) and rows[1].score > rows[2].score + 0.5


def test_lm_words_come_with_the_answers(docs):
    """However many words there are, scoring joins nothing and explodes no word; two words may share the 48 bits of a key."""
    scored = bloom_lm.score(docs.select("doc_id", "text"), docs, max_words=3)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Aggregate" not in plan
    n = Counter(w for r in ROWS for w in [*re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower()), None])
    for r in scored.collect():
        text = next(x[1] for x in ROWS if x[0] == r.doc_id)
        said = [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), None]
        assert r.base_score == pytest.approx(sum(np.log10((n[w] + 1) / (n.total() + len(n) + 1)) for w in said)) and r.n_known == len(said)
    words = np.array([5 << 16, (5 << 16) + 1, (5 << 16) + 65535, 9 << 40], np.uint64)
    keys = np.array([1, 5, 6, 9 << 24], np.uint64)
    assert (bloom_lm.unpack_words(bloom_lm.pack_words(words, keys), keys, 4) == words).all()


def test_lm_numbered():
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 1 << 14, 9000, np.uint64), rng.integers(0, 300, 500, np.uint64) << np.uint64(6), np.empty(0, np.uint64), np.array([7], np.uint64)):
        for got, expected in zip(bloom_lm.numbered(x), np.unique(x, return_inverse=True)):
            assert (got == expected).all()


def test_lm_levels_from_known_ones():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(0, 1 << 48, 20_000, dtype=np.uint64)), rng.integers(1, 99, 20_000)
    segment, top = bloom_lm.Filter.build(keys, counts), bloom_lm.levels(counts)
    assert (segment.level(keys, top) == segment.level(keys)).all()
    assert (segment.level(keys + np.uint64(1), 0 * top) == segment.level(keys + np.uint64(1))).all()


def test_rare_language(spark, monkeypatch):
    rng = np.random.default_rng(1)
    common, rare = ([f"{a}{b}{c}" for a in x for b in x for c in x[:4]] for x in ("etaoins", "xqzjkvw"))
    rows = [(i, " ".join(rng.choice(common[:60], 400)), "en") for i in range(200)] + [(1000, " ".join(rng.choice(rare, 60)), "xx")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).cache()
    # less than 1/1000 of the words: no reference, so base rules alone
    refs = quality_rules.references(table)
    got = {r.doc_id: r for r in quality_rules.measure(table, refs).collect()}
    assert set(refs) == {"en"} and got[1000].kept and not got[1000].base_failed and got[1000].char_distance is None
    assert quality_rules.keep(table, refs).filter("doc_id = 1000").count() == 1
    assert got[1].kept and got[1].char_distance < 0.1
    # a reference from so many words on, whatever the share
    monkeypatch.setattr(quality_rules, "REFERENCE", 50)
    assert set(quality_rules.references(table)) == {"en", "xx"}
