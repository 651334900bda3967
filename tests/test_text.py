import pytest
from pyspark.sql import functions as F

from textprov.functions import text, tokens
from textprov.operators import sampling
from textprov.operators.vectorizer import Params, Vectorizer

CASES = [
    ('a quote & "x"', 'a "e & "x'),
    ("WASHINGTON — The cat", "WASHINGTON cat"),
    ("then EST EDT gone", "then EDT gone"),
    ("[2020 census]", "census]"),
    ("RESULTING METHODS We", "ING We"),
    ("x, Ala. y, Ohio z", "x, Ala. y, z"),
]


@pytest.mark.parametrize("given,expected", CASES)
def test_clean(spark, given, expected):
    row = spark.createDataFrame([(given,)], "text string").select(text.clean(F.col("text")).alias("t")).first()
    assert row.t == expected


def test_clean_drops_empty(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",), ("a",)], "text string")
    assert [r.text for r in text.clean_rows(rows).collect()] == ["a"]


def test_fit_transform_is_fit_then_transform(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string")
    params = Params((2,), 1, 1.0, True)
    one = {(r.doc_id, tuple(r.ngram)): r.value for r in Vectorizer(params).fit_transform(docs).collect()}
    two = {(r.doc_id, tuple(r.ngram)): r.value for r in Vectorizer(params).fit(docs).transform(docs).collect()}
    assert one == two and {d for d, _ in one} == {1, 2}
    assert abs(sum(v * v for (d, _), v in one.items() if d == 1) - 1) < 1e-9


def test_bounds_and_errors(spark):
    assert Params((2,), 0.5, 1.0).bounds(3) == (2, 3)
    with pytest.raises(ValueError):
        Params(())
    with pytest.raises(ValueError):
        tokens.chunks(F.array(), 10, 10)
    rows = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int")
    with pytest.raises(ValueError):
        sampling.stratified_sample(rows, 2)


def test_vectorizer_counts_byte_pairs(spark, tmp_path):
    import math
    from collections import Counter

    import public_tokenizers

    rows = [(1, "The cats' unbelievably long-winded tale, the cats' tale."), (2, "the cats' tale; unbelievably"), (3, "x"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encode = tokens._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    tf = {}
    for i, t in rows:
        ids = encode(t or "")
        tf[i] = Counter(tuple(ids[k : k + n]) for n in (1, 2) for k in range(len(ids) - n + 1))
    df = Counter(g for c in tf.values() for g in c)
    expected = {}
    for i, c in tf.items():
        w = {g: (1 + math.log(n)) * (math.log(5 / (df[g] + 1)) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        expected |= {(i, g): x / norm for g, x in w.items()}
    fitted = Vectorizer(Params((1, 2), 1, 1.0, True)).fit(docs)
    got = {(r.doc_id, tuple(r.ngram)): r.value for r in fitted.transform(docs).collect()}
    assert got == pytest.approx(expected)
    assert [tuple(r.ngram) for r in fitted.vocab.orderBy("feature").collect()] == sorted(df)
    fitted.save(str(tmp_path / "v"))
    again = Vectorizer.load(spark, str(tmp_path / "v"))
    assert again.tokenizer == "byte_bpe_50k" and {(r.doc_id, tuple(r.ngram)): r.value for r in again.transform(docs).collect()} == pytest.approx(expected)
    words = Vectorizer(Params((1,), 1, 1.0, True), "words").fit_transform(docs)
    assert {r.ngram[0] for r in words.collect()} >= {"cats'", "long-winded"}


def test_token_frequencies_has_all_ranks(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from textprov.plans import queries

    docs = [(i, " ".join(f"w{k}" for k in range(150 + i)), "s") for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(map(tuple, queries.QUERIES["token_frequencies"](spark, str(tmp_path)).select("label", "token", "n", "rank").collect()))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.SQL["token_frequencies"]).fetchall())
    assert max(r[3] for r in got) == 153 and len(got) == 152 + 153


def test_samples_take_distinct_rows(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, label int")
    assert sorted(r.doc_id for r in sampling.stratified_sample(rows, 2).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in sampling.sample(rows, 4).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        sampling.stratified_sample(rows, 3)


def brute_df(docs, sizes):
    from collections import Counter

    found = Counter()
    for text in docs:
        t = (text or "").split()
        found.update({tuple(t[i : i + n]) for n in sizes for i in range(len(t) - n + 1)})
    return found


def test_vocabulary_of_many_ranges_and_flushes(spark, monkeypatch):
    import numpy as np

    from textprov.operators import ngrams

    monkeypatch.setattr(ngrams, "HELD", 200)
    rng = np.random.default_rng(5)
    docs = [" ".join(rng.choice(["a", "b", "c", "dd"], rng.integers(0, 9))) for _ in range(90)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    made = Vectorizer(Params((1, 2, 3), 2, 0.5, True), "words").fit(rows)
    want = {g: n for g, n in brute_df(docs, (1, 2, 3)).items() if 2 <= n <= 46}
    found = made.vocab.orderBy("feature").collect()
    assert [tuple(r.ngram) for r in found] == sorted(want) and {tuple(r.ngram): r.df for r in found} == want and [r.feature for r in found] == list(range(len(want)))
    by_hash = ngrams.frequencies(rows.select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("tokens")).filter("text <> ''"), (2,), 1, 1 << 40, 64)
    assert sorted(r.df for r in by_hash.collect()) == sorted(brute_df(docs, (2,)).values())


def test_values_and_sums_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string")
    made = Vectorizer(Params((2,), 1, 1.0, True), "words").fit(docs)
    one = made.transform(docs)
    sums = made.sums(docs, made.weigh(made.vocab.select("feature", (F.col("feature") + 1.0).alias("c"))))
    for df in (one, sums):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    by = {}
    for r in one.collect():
        n, c = by.get(r.doc_id, (0, 0.0))
        by[r.doc_id] = (n + 1, c + r.value * (r.feature + 1))
    assert {r.doc_id: (r.n_features, pytest.approx(r.c)) for r in sums.collect()} == {i: by.get(i, (0, 0.0)) for i in (1, 2, 3, 4)}


def test_ngram_counts_and_frequencies_by_hand(spark, monkeypatch):
    from collections import Counter

    from textprov.operators import ngrams
    from textprov.operators import vectorizer as V

    monkeypatch.setattr(ngrams, "HELD", 64)
    docs = ["a b a b é", "a b", "", None, "b a b a b a", "x", "a b a b a"]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    got = V.counts(rows, (2,))
    assert "Exchange hashpartitioning(doc_id" not in got._jdf.queryExecution().executedPlan().toString()
    tf = {(i, g): n for i, t in enumerate(docs) for g, n in Counter(zip((t or "").split(), (t or "").split()[1:])).items()}
    assert {(r.doc_id, tuple(r.ngram)): r.tf for r in got.collect()} == tf
    found = ngrams.text_frequencies(V.tokenised(rows), (2, 4), 16)
    assert "array" not in found.schema.simpleString()
    assert sorted((r.ngram, r.df) for r in found.collect()) == sorted((" ".join(g), n) for g, n in brute_df(docs, (2, 4)).items())


def test_byte_pairs_are_encoded_a_few_texts_at_a_time(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "ENCODED", 8)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(1, "some words of a text"), (2, None), (3, ""), (4, "é"), (5, "<|endoftext|> x" * 9)]
    got = tokens.bpe_rows(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN)
    encode = tokens._encoding(path, public_tokenizers.PATTERN).encode_ordinary
    assert {r.doc_id: r.tokens for r in got.collect()} == {i: encode(t or "") for i, t in rows}
