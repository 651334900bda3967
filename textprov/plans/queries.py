"""Registered queries for the classifier's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.text import STEPS, clean_rows
from ..operators import classify, curate, evaluate, ngrams, reduction, sampling, score, tables, train
from ..operators import vectorizer as V
from ..sources import texts

PARAMS = V.Params((2, 3, 4), 10, 0.8, True)
THRESHOLD = 0.5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer partitions than cores, so a small one, is spread over all; others are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def docs(spark, d) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id", "text"))


def labelled(spark, d) -> DataFrame:
    labels = read(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return read(spark, d, "documents").select("doc_id", "text", "source").join(labels, "doc_id")


def fitted(spark, d, params: V.Params = PARAMS) -> V.Vectorizer:
    return V.Vectorizer(params, "words").fit(docs(spark, d))


def tfidf_of(spark, d, params: V.Params):
    values = fitted(spark, d, params).transform(docs(spark, d))
    return values.select("doc_id", F.array_join("ngram", " ").alias("ngram"), r6("value").alias("value"))


def tfidf_values(spark, d):
    return tfidf_of(spark, d, PARAMS)


def tfidf_raw(spark, d):
    return tfidf_of(spark, d, V.Params((2, 4), 10, 1.0, False))


def vocabulary_indexed(spark, d):
    return fitted(spark, d).vocab.select("feature", F.array_join("ngram", " ").alias("ngram"), "df", r6("idf").alias("idf"))


def ngram_counts(spark, d):
    return V.counts(docs(spark, d), (2,)).select("doc_id", F.array_join("ngram", " ").alias("ngram"), "tf")


def ngram_df(spark, d):
    rows = docs(spark, d)
    return ngrams.text_frequencies(V.tokenised(rows), (2, 4), rows.count() // 64)


def zero_feature_docs(spark, d):
    made = fitted(spark, d)
    return made.sums(docs(spark, d), made.weigh(made.vocab.select("feature"))).filter("n_features = 0").select("doc_id")


def nb_model(spark, d) -> tuple[V.Vectorizer, DataFrame]:
    made = fitted(spark, d)
    return made, classify.naive_bayes(made.transform(docs(spark, d), ngram=False), labelled(spark, d), made.vocab)


def nb_train(spark, d):
    return nb_model(spark, d)[1].select("feature", r6("log0").alias("log0"), r6("log1").alias("log1"))


def nb_p(spark, d) -> DataFrame:
    made, model = nb_model(spark, d)
    sums = made.sums(docs(spark, d), made.weigh(model.select("feature", F.col("log0").alias("j0"), F.col("log1").alias("j1"))))
    return classify.naive_bayes_p(sums, labelled(spark, d))


def nb_score(spark, d):
    return nb_p(spark, d).select("doc_id", F.round("p", 5).alias("p"), classify.classification(F.round("p", 5), THRESHOLD).alias("classification"))


#: A score that any engine repeats exactly: evaluation queries are checked on it.
def scored(spark, d) -> DataFrame:
    p = F.conv(F.substring(F.md5(F.concat(F.lit("p:"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("double") / 65536
    p = F.round((p + F.col("label")) / 2, 3)
    return labelled(spark, d).select("doc_id", "source", "label", p.alias("p")).withColumn("predicted", (F.col("p") >= THRESHOLD).cast("int"))


def tokens_by_label(spark, d) -> DataFrame:
    return labelled(spark, d).select("label", F.explode(T.words(F.col("text"))).alias("token"))


def chunk_documents(spark, d):
    parts = T.chunks(T.words(F.col("text")), 300, 50)
    dataset = F.coalesce("source", F.lit("unknown")).alias("dataset")
    rows = spread(read(spark, d, "documents").select("doc_id", "source", "text")).select("doc_id", dataset, parts.alias("parts"))
    rows = rows.select("doc_id", "dataset", F.size("parts").alias("num_chunks"), F.posexplode("parts").alias("chunk_idx", "c"))
    return rows.select("doc_id", "dataset", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("num_chunks").cast("long").alias("num_chunks"), F.array_join("c", " ").alias("text"))


def position_chunks(spark, d):
    rows = docs(spark, d).select("doc_id", T.words(F.col("text")).alias("t")).withColumn("n", F.size("t")).filter("n >= 100")
    k = F.least(F.lit(50), F.floor(F.col("n") / 5).cast("int"))
    middle = F.floor(F.col("n") / 2).cast("int") - F.floor(k / 2).cast("int") + 1
    parts = {"first": F.slice("t", 1, k), "middle": F.slice("t", middle, k), "last": F.slice("t", -k, k)}
    return rows.select("doc_id", *(F.array_join(c, " ").alias(f"{n}_part") for n, c in parts.items()))


def assistant_turns(spark, d):
    # the table is flat already: gathering turns only to explode them would shuffle whole conversations
    rows = read(spark, d, "conversations").filter("role = 'assistant'")
    return rows.select("conv_id", "turn", "text", F.lit(1).alias("label"))


def split_counts(spark, d):
    rows = sampling.stratified_split(labelled(spark, d), ["source", "label"])
    return rows.groupBy("source", "label", "is_test").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def pairs(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.col("text").alias("human"), F.concat("text", F.lit("!")).alias("ai"))
    return sampling.unpivot_pairs(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def union_diagonal(spark, d):
    frames = [read(spark, d, "documents").select("text", "source"), read(spark, d, "benchmark").select("item_id", "text")]
    out = sampling.union_all(frames)
    return out.select("text", "source", F.col("item_id").cast("string").alias("item_id"))


def dedup(spark, d):
    return sampling.distinct_texts(labelled(spark, d).select("doc_id", "text", "label"), ["text", "label"]).select("doc_id", "label")


def json_output(spark, d):
    return scored(spark, d).select("doc_id", score.as_json(F.col("p"), THRESHOLD).alias("json"))


def clean_documents(spark, d):
    text = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("text"), F.lit(" (AP) - RESULTS: end&amp;gone <b>x</b>  y"))
    return clean_rows(docs(spark, d).select("doc_id", text.alias("text")))


def bpe_tokens(spark, d):
    import public_tokenizers

    return T.bpe_rows(docs(spark, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Scores of parts of documents that any engine repeats.
def positions(spark, d) -> DataFrame:
    def p(name: str) -> F.Column:
        x = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), F.col("doc_id").cast("string"))), 1, 4), 16, 10).cast("double") / 65536
        return F.round((x + F.col("label")) / 2, 3).alias(f"p_{name}")

    return labelled(spark, d).select("doc_id", "label", *(p(x) for x in ("start", "middle", "end")))


def coefficients(vocab: DataFrame) -> DataFrame:
    # a product of ints ends in an overflow from feature 271,180 on
    return vocab.select("feature", (F.pmod(F.col("feature").cast("long") * 7919, F.lit(1000)) / 500.0 - 1).alias("coef"))


def linear_score(spark, d):
    made = fitted(spark, d)
    sums = made.sums(docs(spark, d), made.weigh(coefficients(made.vocab)))
    return sums.select("doc_id", r6(classify.linked(F.col("coef") + 0.25)).alias("p"))


def soft_vote(spark, d):
    rows = scored(spark, d).join(positions(spark, d).drop("label"), "doc_id")
    p = classify.soft_vote({"p": 0.25, "p_start": 0.3, "p_middle": 0.3, "p_end": 0.15})
    return rows.select("doc_id", r6(p).alias("p"), classify.classification(r6(p), THRESHOLD).alias("classification"))


def top_features(spark, d):
    vocab = fitted(spark, d).vocab
    return evaluate.top_features(coefficients(vocab), vocab).select("side", "feature", F.array_join("ngram", " ").alias("ngram"), r6("coef").alias("coef"))


def sparsity(spark, d):
    made = fitted(spark, d)
    return _rounded(V.sparsity_of(made))


def output_formats(spark, d):
    p = F.col("p")
    return scored(spark, d).select("doc_id", *(score.formatted(p, how, THRESHOLD).alias(how.replace("-", "_")) for how in ("class", "class-id", "probability", "human")), score.shown(p).alias("shown"))


def expansion(spark, d):
    """Chunks a document, of the chunked corpus with its own columns."""
    parts = T.chunks(T.words(F.col("text")), 300, 50)
    rows = read(spark, d, "documents").select(F.coalesce("source", F.lit("unknown")).alias("dataset"), F.size(parts).alias("n"))
    return _rounded(rows.groupBy("dataset").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("docs"), F.avg("n").alias("ratio")))


def answers_of_two(spark, d):
    """Two conversations a row, as an arena stores them: unpivoted, filtered and exploded."""
    rows = read(spark, d, "conversations").select("conv_id", F.array(F.struct("role", F.col("text").alias("content"))).alias("conversation_a"))
    rows = rows.withColumn("conversation_b", F.transform("conversation_a", lambda m: F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("!")).alias("content"))))
    return curate.arena(rows, "x/arena").groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def quotas(spark, d):
    """A corpus by quotas: all of one source, samples of others."""
    rows = labelled(spark, d).select("doc_id", "text", "label", "source")
    parts = {n: rows.filter(F.col("source") == n).drop("source") for n in ("src0", "src1", "src2")}
    out = curate.by_quotas(parts, [("src0", "all", None), ("src1", "sample", 5), ("src2", "sample", 3)])
    return out.select("doc_id", "label", "dataset")


def vote_p(spark, d) -> score.Predictor:
    """The four models fitted on labelled documents."""
    made = V.Vectorizer(V.Params((1, 2), 10, 0.8, True), "words")
    rows = labelled(spark, d)
    values = tables.written(made.fit_transform(rows.select("doc_id", "text"), ngram=False), "values")
    return score.Predictor(made, train.ensemble(values, rows.select("doc_id", "label"), made.vocab)).prepare(spark)


def ensemble_score(spark, d):
    """Documents scored by the vote of models that are trained on the labelled ones."""
    return vote_p(spark, d).classify(docs(spark, d)).select("doc_id", r6("p_ai").alias("p_ai"), "classification")


def svd_variance(spark, d):
    made = V.Vectorizer(V.Params((1, 2), 10, 0.8, True), "words")
    values = made.fit_transform(docs(spark, d), ngram=False)
    rows = values.groupBy("doc_id").agg(F.collect_list("feature").alias("at"), F.collect_list("value").alias("values"))
    one, _, shares = reduction.svd(tables.written(rows, "rows"), made.num_features, 20)
    return spark.createDataFrame([(i, round(float(s), 4), round(float(v), 5)) for i, (s, v) in enumerate(zip(one, shares))], "component int, singular_value double, variance double")


def points(spark, d) -> DataFrame:
    """Two coordinates of each vector, with labels 0 and 1."""
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label"))
    return rows.select("vec_id", "x", "y", F.concat(F.lit("s"), F.pmod("label", F.lit(7)).cast("string")).alias("source"), F.pmod("label", F.lit(2)).cast("int").alias("label"))


_C = evaluate
QUERIES = {
    "linear_score": linear_score,
    "soft_vote": soft_vote,
    "top_features": top_features,
    "sparsity": sparsity,
    "output_formats": output_formats,
    "chunk_expansion": expansion,
    "arena_answers": answers_of_two,
    "curated_by_quotas": quotas,
    "ensemble_score": ensemble_score,
    "svd_variance": svd_variance,
    "balanced_weights": lambda s, d: _rounded(classify.balanced_weights(labelled(s, d))),
    "det_curve": lambda s, d: _rounded(_C.det(_C.thresholds(scored(s, d)))),
    "majority_confusion": lambda s, d: _C.majority(scored(s, d)),
    "uncertainty_split": lambda s, d: _rounded(_C.uncertainty(scored(s, d), THRESHOLD)),
    "lowest_sources": lambda s, d: _rounded(_C.lowest_sources(scored(s, d))),
    "largest_confusions": lambda s, d: _rounded(_C.largest_confusions(scored(s, d))),
    "error_colours": lambda s, d: _rounded(_C.error_colours(_C.per_source(scored(s, d)))),
    "hardest_and_easiest": lambda s, d: _rounded(_C.hardest_and_easiest(_C.per_source(scored(s, d)))),
    "position_stats": lambda s, d: _rounded(_C.position_stats(positions(s, d))),
    "start_end_fit": lambda s, d: _rounded(_C.start_end(positions(s, d))),
    "position_variance": lambda s, d: _rounded(_C.position_variance(positions(s, d))),
    "vocabulary_sizes": lambda s, d: _C.vocabulary_sizes(tokens_by_label(s, d)),
    "stripped": lambda s, d: texts.strip_strings(read(s, d, "documents").select("doc_id", F.concat(F.lit(" \n\t"), "text", F.lit("\u00a0 ")).alias("text"), "lang")),
    "labels_cast": lambda s, d: curate.cast_label(labelled(s, d)).select("doc_id", F.col("label").cast("int").alias("label")),
    "centroids": lambda s, d: _rounded(reduction.centroids(points(s, d))),
    "centroid_separation": lambda s, d: _rounded(reduction.separation(points(s, d))),
    "density_grid": lambda s, d: reduction.densities(points(s, d), 20).select("label", "i", "j", F.round("density", 4).alias("density")),
    "tfidf_values": tfidf_values,
    "tfidf_raw": tfidf_raw,
    "vocabulary_indexed": vocabulary_indexed,
    "ngram_counts": ngram_counts,
    "ngram_df": ngram_df,
    "zero_feature_docs": zero_feature_docs,
    "nb_train": nb_train,
    "nb_score": nb_score,
    "stratified_sample": lambda s, d: sampling.stratified_sample(labelled(s, d), 10).select("doc_id", "label"),
    "sample": lambda s, d: sampling.sample(docs(s, d), 50).select("doc_id"),
    "stratified_split_counts": split_counts,
    "unpivot_pairs": pairs,
    "union_diagonal": union_diagonal,
    "dedup_text_label": dedup,
    "conversation_assistant_turns": assistant_turns,
    "chunk_documents": chunk_documents,
    "position_chunks": position_chunks,
    "clean_documents": clean_documents,
    "confusion": lambda s, d: _C.confusion(scored(s, d)),
    "confusion_by_source": lambda s, d: _C.confusion(scored(s, d), ["source"]),
    "metrics": lambda s, d: _rounded(_C.metrics(_C.confusion(scored(s, d)))),
    "best_f1_threshold": lambda s, d: _rounded(_C.best_f1(_C.thresholds(scored(s, d)))),
    "youden_threshold": lambda s, d: _rounded(_C.youden(_C.thresholds(scored(s, d)))),
    "roc_auc": lambda s, d: _rounded(_C.roc_auc(_C.thresholds(scored(s, d)))),
    "calibration_bins": lambda s, d: _rounded(_C.calibration(scored(s, d))),
    "histogram_bins": lambda s, d: _C.histogram(scored(s, d)),
    "separation_gap": lambda s, d: _rounded(_C.separation(scored(s, d))),
    "per_source_accuracy": lambda s, d: _rounded(_C.per_source(scored(s, d))),
    "error_rate_topk": lambda s, d: _rounded(_C.per_source(scored(s, d)).orderBy(F.desc(F.round("error_rate", 6)), "source").limit(15).select("source", "error_rate")),
    "token_zipf": lambda s, d: _C.token_counts(tokens_by_label(s, d)).filter("rank <= 100"),
    "token_frequencies": lambda s, d: _C.token_counts(tokens_by_label(s, d)),
    "token_kl": lambda s, d: _rounded(_C.kl_divergence(tokens_by_label(s, d))),
    "json_output": json_output,
    "bpe_tokenize": bpe_tokens,
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _tf(sizes: tuple[int, ...]) -> str:
    one = " UNION ALL ".join(f"SELECT doc_id, t[i:i + {n - 1}] AS ngram FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM tok)" for n in sizes)
    return f"tok AS (SELECT doc_id, {_W} AS t FROM documents), tf AS (SELECT doc_id, ngram, count(*) AS tf FROM ({one}) GROUP BY ALL)"


def _tfidf(params: V.Params) -> str:
    lo, hi = (f"ceil({b} * n)" if b < 1 or (b == 1 and k) else f"{int(b)}" for k, b in enumerate((params.min_df, params.max_df)))
    tf = "1 + ln(tf)" if params.sublinear_tf else "tf"
    return f"""WITH {_tf(params.sizes)}, size AS (SELECT count(*)::DOUBLE AS n FROM documents),
dfs AS (SELECT ngram, count(*) AS df FROM tf GROUP BY ngram),
vocab AS (SELECT row_number() OVER (ORDER BY ngram) - 1 AS feature, ngram, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM dfs, size WHERE df >= {lo} AND df <= {hi}),
w AS (SELECT doc_id, feature, ngram, ({tf}) * idf AS w FROM tf JOIN vocab USING (ngram)),
v AS (SELECT doc_id, feature, ngram, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM w)"""


_LABELLED = "SELECT doc_id, text, source, quality AS label FROM documents JOIN labels USING (doc_id)"
_SCORED = f"""scored AS (SELECT doc_id, source, label, p, CAST(p >= {THRESHOLD} AS INT) AS predicted FROM (
  SELECT doc_id, source, label, round((('0x' || md5('p:' || doc_id)[1:4])::INT / 65536.0::DOUBLE + label) / 2, 3) AS p FROM ({_LABELLED})))"""
_CONF = "count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 1 AND predicted = 0) AS fn"
_CURVE = f"""{_SCORED}, curve AS (SELECT p, sum(n1) OVER (ORDER BY p DESC) AS tp, sum(n0) OVER (ORDER BY p DESC) AS fp, sum(n1) OVER () AS pos, sum(n0) OVER () AS neg
  FROM (SELECT p, sum(label) AS n1, sum(1 - label) AS n0 FROM scored GROUP BY p))"""
_SOURCES = "SELECT source, count(*) AS n, avg((label = predicted)::INT) AS accuracy, avg(label) AS ai_ratio, avg(p) AS mean_p FROM scored GROUP BY source"
_NB = f"""{_tfidf(PARAMS)}, lab AS ({_LABELLED}),
s AS (SELECT vocab.feature, coalesce(sum(value) FILTER (label = 0), 0) + {classify.ALPHA} AS s0, coalesce(sum(value) FILTER (label = 1), 0) + {classify.ALPHA} AS s1
  FROM vocab LEFT JOIN (SELECT feature, value, label FROM v JOIN lab USING (doc_id)) x ON vocab.feature = x.feature GROUP BY vocab.feature),
nb AS (SELECT feature, ln(s0 / sum(s0) OVER ()) AS log0, ln(s1 / sum(s1) OVER ()) AS log1 FROM s)"""
_TOKENS = f"tokens AS (SELECT label, unnest({_W}) AS token FROM ({_LABELLED}))"
_PART = "array_to_string(t[{}], ' ')"

def _clean_sql(text: str) -> str:
    for pattern, to in STEPS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return f"trim(trim(trim({text}, {_SPACE}), chr(39) || chr(34)), {_SPACE})"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DIRTY = "'[' || doc_id || '] ' || text || ' (AP) - RESULTS: end&amp;gone <b>x</b>  y'"

def _p(name: str) -> str:
    return f"round((('0x' || md5('{name}:' || doc_id)[1:4])::INT / 65536.0::DOUBLE + label) / 2, 3)"


_POSITIONS = f"positions AS (SELECT doc_id, label, {_p('start')} AS p_start, {_p('middle')} AS p_middle, {_p('end')} AS p_end FROM ({_LABELLED}))"
_VOTE = "round(p * 0.25 + p_start * 0.3 + p_middle * 0.3 + p_end * 0.15, 6)"
_COEF = "(feature * 7919 % 1000) / 500.0::DOUBLE - 1"
_CHUNKS = "CASE WHEN n <= 300 THEN 1 ELSE CAST(ceil((n - 300) / 250.0) AS BIGINT) + 1 END"
_POINTS = "points AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 's' || (label % 7) AS source, label % 2 AS label FROM embeddings)"
SQL = {
    "linear_score": f"""{_tfidf(PARAMS)}, m AS (SELECT doc_id, sum(value * ({_COEF})) AS m FROM v GROUP BY doc_id)
SELECT doc_id, round(1 / (1 + exp(-(coalesce(m, 0) + 0.25))), 6) AS p FROM documents LEFT JOIN m USING (doc_id)""",
    "soft_vote": f"WITH {_SCORED}, {_POSITIONS} SELECT doc_id, {_VOTE} AS p, CASE WHEN {_VOTE} >= {THRESHOLD} THEN 'AI' ELSE 'Human' END AS classification FROM scored JOIN positions USING (doc_id)",
    "top_features": f"""{_tfidf(PARAMS)}, c AS (SELECT CAST(feature AS INT) AS feature, array_to_string(ngram, ' ') AS ngram, {_COEF} AS c FROM vocab)
(SELECT 'ai' AS side, feature, ngram, round(c, 6) AS coef FROM c ORDER BY c.c DESC, feature LIMIT 20) UNION ALL (SELECT 'human', feature, ngram, round(c, 6) FROM c ORDER BY c.c, feature LIMIT 20)""",
    "sparsity": f"""{_tfidf(PARAMS)} SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM vocab) AS n_columns, count(*) AS n_values,
round(100 * (1 - count(*) / ((SELECT count(*) FROM documents)::DOUBLE * (SELECT count(*) FROM vocab))), 6) AS sparsity FROM v""",
    "output_formats": f"""WITH {_SCORED}, k AS (SELECT *, CASE WHEN p >= {THRESHOLD} THEN 'AI' ELSE 'Human' END AS c FROM scored)
SELECT doc_id, c AS class, CAST(predicted AS VARCHAR) AS class_id, printf('%.4f', p) AS probability,
'Result: ' || CASE WHEN predicted = 1 THEN 'ai' ELSE 'human' END || chr(10) || 'Confidence: ' || printf('%.1f', 100 * CASE WHEN predicted = 1 THEN p ELSE 1 - p END) || '%' AS human,
'P(Human)=' || printf('%.3f', 1 - p) || ', P(AI)=' || printf('%.3f', p) AS shown FROM k""",
    "chunk_expansion": f"""SELECT dataset, CAST(sum(k) AS BIGINT) AS chunks, count(*) AS docs, round(avg(k), 6) AS ratio
FROM (SELECT coalesce(source, 'unknown') AS dataset, {_CHUNKS} AS k FROM (SELECT source, len({_W}) AS n FROM documents)) GROUP BY dataset""",
    "arena_answers": "SELECT 'x/arena' AS dataset, CAST(1 AS TINYINT) AS label, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT text AS t FROM conversations WHERE role = 'assistant' UNION ALL SELECT text || '!' FROM conversations WHERE role = 'assistant')",
    "curated_by_quotas": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS r FROM ({_LABELLED}))
SELECT doc_id, label, source AS dataset FROM l WHERE source = 'src0' OR source = 'src1' AND r <= 5 OR source = 'src2' AND r <= 3 QUALIFY row_number() OVER (PARTITION BY text, label ORDER BY source, doc_id) = 1""",
    "balanced_weights": f"SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM ({_LABELLED}) GROUP BY label",
    "det_curve": f"WITH {_CURVE} SELECT p, round(fp / neg, 6) AS fpr, round(1 - tp / pos, 6) AS fnr FROM curve",
    "majority_confusion": f"WITH {_SCORED}, m AS (SELECT CAST(sum(label) * 2 > count(*) AS INT) AS m FROM scored), g AS (SELECT label, m AS predicted FROM scored, m) SELECT {_CONF} FROM g",
    "uncertainty_split": f"""WITH {_SCORED} SELECT (p > {THRESHOLD})::INT = label AS correct, count(*) AS n, round(avg(abs(p - {THRESHOLD})), 6) AS mean_distance, round(max(abs(p - {THRESHOLD})), 6) AS max_distance FROM scored GROUP BY 1""",
    "lowest_sources": f"WITH {_SCORED} SELECT source, round(avg(p), 6) AS mean_p, round(median(p), 6) AS median_p FROM scored GROUP BY source ORDER BY round(avg(p), 9), source LIMIT 15",
    "largest_confusions": f"""WITH {_SCORED}, c AS (SELECT source, count(*) AS n, {_CONF} FROM scored GROUP BY source)
SELECT source, n, round(tn / n, 6) AS tn, round(fp / n, 6) AS fp, round(fn / n, 6) AS fn, round(tp / n, 6) AS tp FROM c ORDER BY n DESC, source LIMIT 12""",
    "error_colours": f"""WITH {_SCORED}, m AS ({_SOURCES}) SELECT source, round(1 - accuracy, 6) AS error_rate, CASE WHEN 1 - accuracy > 0.1 THEN 'red' WHEN 1 - accuracy > 0.05 THEN 'orange' ELSE 'green' END AS colour
FROM m ORDER BY 2 DESC, source LIMIT 15""",
    "hardest_and_easiest": f"""WITH {_SCORED}, m AS ({_SOURCES}), r AS (SELECT source, n, round(accuracy, 6) AS accuracy, round(mean_p, 6) AS mean_p FROM m)
(SELECT *, 'hardest' AS side FROM r ORDER BY accuracy, source LIMIT 5) UNION ALL (SELECT *, 'easiest' FROM r ORDER BY accuracy DESC, source DESC LIMIT 5)""",
    "position_stats": f"""WITH {_POSITIONS}, u AS (UNPIVOT positions ON p_start, p_middle, p_end INTO NAME k VALUE p)
SELECT k[3:] AS position, label, round(avg(p), 6) AS mean_p, round(stddev_pop(p), 6) AS std_p, round(avg(((p > {THRESHOLD})::INT = label)::INT), 6) AS accuracy, count(*) AS n FROM u GROUP BY ALL""",
    "start_end_fit": f"""WITH {_POSITIONS}, f AS (SELECT corr(p_start, p_end) AS c, regr_slope(p_end, p_start) AS m, regr_intercept(p_end, p_start) AS b, avg(p_start) AS x, avg(p_end) AS y FROM positions)
SELECT round(c, 6) AS corr, round(m, 6) AS slope, round(b, 6) AS intercept, round(x, 6) AS mean_x, round(y, 6) AS mean_y, round(CASE WHEN m <> 0 THEN -1 / m ELSE 0 END, 6) AS across_slope,
round(y - CASE WHEN m <> 0 THEN -1 / m ELSE 0 END * x, 6) AS across_intercept FROM f""",
    "position_variance": f"""WITH {_POSITIONS}, v AS (SELECT (p_middle > {THRESHOLD})::INT = label AS correct, list_var_pop([p_start, p_middle, p_end]) AS v FROM positions)
SELECT correct, count(*) AS n, round(avg(v), 6) AS mean_variance, round(max(v), 6) AS max_variance FROM v GROUP BY correct""",
    "vocabulary_sizes": f"WITH {_TOKENS} SELECT label, count(DISTINCT token) AS vocabulary FROM tokens GROUP BY label",
    "stripped": "SELECT doc_id, regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS text, lang FROM documents",
    "labels_cast": f"SELECT doc_id, label FROM ({_LABELLED})",
    "centroids": f"""WITH {_POINTS}, c AS (SELECT source, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, (avg(label) > 0.5)::INT AS label FROM points GROUP BY source ORDER BY source LIMIT 15) SELECT * FROM c WHERE n > 10""",
    "density_grid": f"""WITH {_POINTS}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
s AS (SELECT label, count(*) AS n, var_samp(x) * count(*) ** (-1 / 3.0) AS xx, var_samp(y) * count(*) ** (-1 / 3.0) AS yy, covar_samp(x, y) * count(*) ** (-1 / 3.0) AS xy FROM points GROUP BY label HAVING count(*) > 10),
g AS (SELECT i, j, x0 + j * (x1 - x0) / 19 AS gx, y0 + i * (y1 - y0) / 19 AS gy FROM box, range(20) a(i), range(20) b(j))
SELECT s.label, CAST(i AS INT) AS i, CAST(j AS INT) AS j,
round(sum(exp(-(yy * (gx - x) ** 2 - 2 * xy * (gx - x) * (gy - y) + xx * (gy - y) ** 2) / (2 * (xx * yy - xy * xy)))) / any_value(2 * pi() * sqrt(xx * yy - xy * xy) * n), 4) AS density
FROM s JOIN points USING (label), g GROUP BY ALL""",
    "centroid_separation": f"""WITH {_POINTS}, c AS (SELECT avg(x) FILTER (label = 0) AS a, avg(y) FILTER (label = 0) AS b, avg(x) FILTER (label = 1) AS c, avg(y) FILTER (label = 1) AS d FROM points)
SELECT round(a, 6) AS x0, round(b, 6) AS y0, round(c, 6) AS x1, round(d, 6) AS y1, round(sqrt((c - a) ** 2 + (d - b) ** 2), 6) AS distance FROM c""",
    "clean_documents": f"SELECT * FROM (SELECT doc_id, {_clean_sql(_DIRTY)} AS text FROM documents) WHERE length(text) > 0",
    "tfidf_values": f"{_tfidf(PARAMS)} SELECT doc_id, array_to_string(ngram, ' ') AS ngram, round(value, 6) AS value FROM v",
    "tfidf_raw": f"{_tfidf(V.Params((2, 4), 10, 1.0, False))} SELECT doc_id, array_to_string(ngram, ' ') AS ngram, round(value, 6) AS value FROM v",
    "vocabulary_indexed": f"{_tfidf(PARAMS)} SELECT CAST(feature AS INT) AS feature, array_to_string(ngram, ' ') AS ngram, df, round(idf, 6) AS idf FROM vocab",
    "ngram_counts": f"WITH {_tf((2,))} SELECT doc_id, array_to_string(ngram, ' ') AS ngram, tf FROM tf",
    "ngram_df": f"WITH {_tf((2, 4))} SELECT array_to_string(ngram, ' ') AS ngram, count(*) AS df FROM tf GROUP BY tf.ngram",
    "zero_feature_docs": f"{_tfidf(PARAMS)} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM v)",
    "nb_train": f"{_NB} SELECT CAST(feature AS INT) AS feature, round(log0, 6) AS log0, round(log1, 6) AS log1 FROM nb",
    "nb_score": f"""{_NB}, j AS (SELECT doc_id, sum(value * log0) AS j0, sum(value * log1) AS j1 FROM v JOIN nb USING (feature) GROUP BY doc_id),
p AS (SELECT doc_id, round(1 / (1 + exp(coalesce(j0, 0) + ln((SELECT avg(1 - label) FROM lab)) - coalesce(j1, 0) - ln((SELECT avg(label) FROM lab)))), 5) AS p FROM documents LEFT JOIN j USING (doc_id))
SELECT doc_id, p, CASE WHEN p >= {THRESHOLD} THEN 'AI' ELSE 'Human' END AS classification FROM p""",
    "stratified_sample": f"SELECT doc_id, label FROM ({_LABELLED}) QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) <= 10",
    "sample": "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
    "stratified_split_counts": f"""SELECT source, label, r <= floor(0.2 * c + 0.5) AS is_test, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source, label) AS c FROM ({_LABELLED})) GROUP BY ALL""",
    "unpivot_pairs": "SELECT label, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT 0 AS label, text AS x FROM documents UNION ALL SELECT 1, text || '!' FROM documents) GROUP BY label",
    "union_diagonal": "SELECT text, source, NULL::VARCHAR AS item_id FROM documents UNION ALL SELECT text, NULL, item_id::VARCHAR FROM benchmark",
    "dedup_text_label": f"SELECT min(doc_id) AS doc_id, label FROM ({_LABELLED}) GROUP BY text, label",
    "conversation_assistant_turns": "SELECT conv_id, turn, text, 1 AS label FROM conversations WHERE role = 'assistant'",
    "chunk_documents": f"""WITH t AS (SELECT doc_id, coalesce(source, 'unknown') AS dataset, {_W} AS t FROM documents), n AS (SELECT *, CASE WHEN len(t) <= 300 THEN 1 ELSE CAST(ceil((len(t) - 300) / 250.0) AS BIGINT) + 1 END AS k FROM t)
SELECT doc_id, dataset, i AS chunk_idx, CAST(k AS BIGINT) AS num_chunks, array_to_string(t[i * 250 + 1:i * 250 + 300], ' ') AS text FROM (SELECT *, unnest(range(k)) AS i FROM n)""",
    "position_chunks": f"""SELECT doc_id, {_PART.format("1:k")} AS first_part, {_PART.format("n // 2 - k // 2 + 1:n // 2 - k // 2 + k")} AS middle_part, {_PART.format("n - k + 1:n")} AS last_part
FROM (SELECT *, least(50, n // 5) AS k FROM (SELECT doc_id, {_W} AS t, len(t) AS n FROM documents) WHERE n >= 100)""",
    "confusion": f"WITH {_SCORED} SELECT {_CONF} FROM scored",
    "confusion_by_source": f"WITH {_SCORED} SELECT source, {_CONF} FROM scored GROUP BY source",
    "metrics": f"""WITH {_SCORED}, c AS (SELECT {_CONF} FROM scored) SELECT round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c""",
    "best_f1_threshold": f"WITH {_CURVE} SELECT p, round(2 * tp / (tp + fp + pos), 6) AS f1 FROM curve ORDER BY 2 * tp / (tp + fp + pos) DESC, p LIMIT 1",
    "youden_threshold": f"WITH {_CURVE} SELECT p, round(tp / pos - fp / neg, 6) AS j FROM curve ORDER BY tp / pos - fp / neg DESC, p DESC LIMIT 1",
    "roc_auc": f"WITH {_CURVE} SELECT round(sum((fp - pf) * (tp + pt) / 2) / max(pos * neg), 6) AS auc FROM (SELECT *, lag(fp, 1, 0) OVER (ORDER BY p DESC) AS pf, lag(tp, 1, 0) OVER (ORDER BY p DESC) AS pt FROM curve)",
    "calibration_bins": f"WITH {_SCORED} SELECT greatest(0, least(9, CAST(ceil(p * 10) AS INT) - 1)) AS bin, round(avg(p), 6) AS mean_p, round(avg(label), 6) AS share, count(*) AS n FROM scored GROUP BY 1",
    "histogram_bins": f"WITH {_SCORED} SELECT label, least(49, CAST(floor(p * 50) AS INT)) AS bin, count(*) AS n FROM scored GROUP BY ALL",
    "separation_gap": f"WITH {_SCORED}, m AS (SELECT max(p) FILTER (label = 0) AS max_human, min(p) FILTER (label = 1) AS min_ai FROM scored) SELECT max_human, min_ai, round(min_ai - max_human, 6) AS gap FROM m",
    "per_source_accuracy": f"""WITH {_SCORED}, m AS ({_SOURCES}) SELECT source, n, round(accuracy, 6) AS accuracy, round(ai_ratio, 6) AS ai_ratio, round(mean_p, 6) AS mean_p, round(1 - accuracy, 6) AS error_rate,
accuracy < 0.85 OR abs(ai_ratio - mean_p) > 0.3 AS outlier FROM m""",
    "error_rate_topk": f"WITH {_SCORED}, m AS ({_SOURCES}) SELECT source, round(1 - accuracy, 6) AS error_rate FROM m ORDER BY 2 DESC, source LIMIT 15",
    "token_zipf": f"WITH {_TOKENS} SELECT label, token, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, token) AS r FROM (SELECT label, token, count(*) AS n FROM tokens GROUP BY ALL)) WHERE r <= 100",
    "token_frequencies": f"WITH {_TOKENS} SELECT label, token, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, token) AS INT) AS rank FROM (SELECT label, token, count(*) AS n FROM tokens GROUP BY ALL)",
    "token_kl": f"""WITH {_TOKENS}, b AS (SELECT token, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM tokens GROUP BY token),
s AS (SELECT (n0 / sum(n0) OVER () + 1e-10) / (1 + 1e-10 * count(*) OVER ()) AS p, (n1 / sum(n1) OVER () + 1e-10) / (1 + 1e-10 * count(*) OVER ()) AS q FROM b)
SELECT round(sum(p * ln(p / q)), 6) AS kl, count(*) AS vocabulary FROM s""",
    "json_output": f"""WITH {_SCORED} SELECT doc_id, '{{"class":' || predicted || ',"class_label":"' || CASE WHEN predicted = 1 THEN 'ai' ELSE 'human' END || '","probabilities":{{"human":' || round(1 - p, 9) || ',"ai":' || p || '}}}}' AS json FROM scored""",
}
