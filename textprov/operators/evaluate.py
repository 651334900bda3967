"""Relational evaluation of scored documents (doc_id, label, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables


def confusion(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn of columns label and predicted."""
    def n(label: int, predicted: int):
        return F.count_if((F.col("label") == label) & (F.col("predicted") == predicted))

    return df.groupBy(*(by or [])).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))


def metrics(confused: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, mcc and balanced accuracy; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def over(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    keys = [c for c in confused.columns if c not in ("tp", "fp", "tn", "fn")]
    return confused.select(
        *keys,
        over(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        over(tp, tp + fp).alias("precision"),
        over(tp, tp + fn).alias("recall"),
        over(2 * tp, 2 * tp + fp + fn).alias("f1"),
        over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        ((over(tp, tp + fn) + over(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def thresholds(df: DataFrame) -> DataFrame:
    """For each distinct p: n1 and n0 rows by label, tp and fp of predicting 1 from it on, and the totals; sums run by ranges of p."""
    by = df.groupBy("p").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    curve = tables.ranged(by, F.desc("p"), {"tp": F.col("n1"), "fp": F.col("n0")}, "curve")
    whole = df.agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    return curve.crossJoin(F.broadcast(whole))  # one row


def best_f1(curve: DataFrame) -> DataFrame:
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("pos"))
    return curve.select("p", f1.alias("f1")).orderBy(F.desc("f1"), "p").limit(1)


def youden(curve: DataFrame) -> DataFrame:
    j = F.col("tp") / F.col("pos") - F.col("fp") / F.col("neg")
    return curve.select("p", j.alias("j")).orderBy(F.desc("j"), F.desc("p")).limit(1)


def roc_auc(curve: DataFrame) -> DataFrame:
    """Area by trapezoids; the point before a threshold lacks its own rows."""
    area = F.col("n0") * (2 * F.col("tp") - F.col("n1")) / 2
    return curve.agg((F.sum(area) / (F.max("pos") * F.max("neg"))).alias("auc"))


def det(curve: DataFrame) -> DataFrame:
    """Detection error trade-off: p, fpr and fnr of predicting 1 from p on."""
    return curve.select("p", (F.col("fp") / F.col("neg")).alias("fpr"), (1 - F.col("tp") / F.col("pos")).alias("fnr"))


def majority(df: DataFrame) -> DataFrame:
    """The constant prediction of the commoner label (0 on ties), and its confusion."""
    label = df.agg((F.sum("label") * 2 > F.count(F.lit(1))).cast("int").alias("predicted"))
    return confusion(df.drop("predicted").crossJoin(F.broadcast(label)))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Bins that hold a row: mean p, share of label 1, rows. An edge belongs to the bin below it."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil(F.col("p") * bins).cast("int") - 1))
    return df.groupBy(at.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg("label").alias("share"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Rows by label and bin of [0, 1]; 1 belongs to the last bin."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins).cast("int"))
    return df.groupBy("label", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def separation(df: DataFrame) -> DataFrame:
    hi, lo = F.max(F.when(F.col("label") == 0, F.col("p"))), F.min(F.when(F.col("label") == 1, F.col("p")))
    return df.agg(hi.alias("max_human"), lo.alias("min_ai"), (lo - hi).alias("gap"))


def per_source(df: DataFrame) -> DataFrame:
    """source, n, accuracy, error_rate, ai_ratio, mean_p and whether it is an outlier."""
    right = F.avg((F.col("label") == F.col("predicted")).cast("double"))
    out = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), right.alias("accuracy"), F.avg("label").alias("ai_ratio"), F.avg("p").alias("mean_p"))
    odd = (F.col("accuracy") < 0.85) | (F.abs(F.col("ai_ratio") - F.col("mean_p")) > 0.3)
    return out.withColumn("error_rate", 1 - F.col("accuracy")).withColumn("outlier", odd)


def uncertainty(df: DataFrame, threshold: float) -> DataFrame:
    """Rows and mean distance of p from the threshold, by whether the prediction (p above it) is right."""
    right = ((F.col("p") > threshold).cast("int") == F.col("label")).alias("correct")
    return df.select(right, F.abs(F.col("p") - threshold).alias("d")).groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"))


def lowest_sources(df: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` sources of lowest mean p, with mean and median."""
    by = df.groupBy("source").agg(F.avg("p").alias("mean_p"), F.percentile("p", F.lit(0.5)).alias("median_p"))
    return by.orderBy(F.round("mean_p", 9), "source").limit(n)


def largest_confusions(df: DataFrame, n: int = 12) -> DataFrame:
    """Shares of tn, fp, fn, tp of the ``n`` largest sources."""
    shares = confusion(df, ["source"]).withColumn("n", F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))
    top = shares.orderBy(F.desc("n"), "source").limit(n)
    return top.select("source", "n", *((F.col(c) / F.col("n")).alias(c) for c in ("tn", "fp", "fn", "tp")))


def error_colours(sources: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` sources of highest error rate (``per_source``) with the colour of their bar."""
    colour = F.when(F.col("error_rate") > 0.1, "red").when(F.col("error_rate") > 0.05, "orange").otherwise("green")
    return sources.orderBy(F.desc(F.round("error_rate", 6)), "source").limit(n).select("source", "error_rate", colour.alias("colour"))


def hardest_and_easiest(sources: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` sources of lowest and of highest accuracy (``per_source``); a source may be among both."""
    rows = sources.select("source", "n", "accuracy", "mean_p")
    low = rows.orderBy(F.round("accuracy", 9), "source").limit(n).withColumn("side", F.lit("hardest"))
    return low.unionByName(rows.orderBy(F.desc(F.round("accuracy", 9)), F.desc("source")).limit(n).withColumn("side", F.lit("easiest")))


def position_stats(df: DataFrame, positions: tuple[str, ...] = ("p_start", "p_middle", "p_end"), threshold: float = 0.5) -> DataFrame:
    """position, label, mean, std (of the whole) and accuracy of the probabilities of parts of documents."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c.removeprefix("p_")).alias("position"), F.col(c).alias("p")) for c in positions)))
    rows = df.select("label", pairs.alias("x")).select("label", "x.*")
    right = ((F.col("p") > threshold).cast("int") == F.col("label")).cast("double")
    return rows.groupBy("position", "label").agg(F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"), F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def start_end(df: DataFrame, x: str = "p_start", y: str = "p_end") -> DataFrame:
    """Correlation, line of best fit, and the line across it through the means (slope 0 where the fit is level)."""
    one = df.agg(F.corr(x, y).alias("corr"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))
    across = F.when(F.col("slope") != 0, -1 / F.col("slope")).otherwise(0.0)
    return one.withColumn("across_slope", across).withColumn("across_intercept", F.col("mean_y") - F.col("across_slope") * F.col("mean_x"))


def position_variance(df: DataFrame, positions: tuple[str, ...] = ("p_start", "p_middle", "p_end"), threshold: float = 0.5) -> DataFrame:
    """Mean over documents of the variance of p over positions, by whether the middle part is judged right."""
    k = len(positions)
    mean = sum((F.col(c) for c in positions), F.lit(0.0)) / k
    var = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in positions), F.lit(0.0)) / k
    right = ((F.col(positions[1]) > threshold).cast("int") == F.col("label")).alias("correct")
    return df.select(right, var.alias("v")).groupBy("correct").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_variance"), F.max("v").alias("max_variance"))


def top_features(coefficients: DataFrame, vocab: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` features of highest and of lowest coefficient, with their n-grams; ties by feature."""
    high = coefficients.orderBy(F.desc("coef"), "feature").limit(n).withColumn("side", F.lit("ai"))
    low = coefficients.orderBy("coef", "feature").limit(n).withColumn("side", F.lit("human"))
    return high.unionByName(low).join(vocab.select("feature", "ngram"), "feature").select("side", "feature", "ngram", "coef")


def token_counts(tokens: DataFrame) -> DataFrame:
    """label, token, n and rank by frequency within the label; numbered by ranges over all labels."""
    by = tokens.groupBy("label", "token").agg(F.count(F.lit(1)).alias("n"))
    rows = tables.ranged(by, F.struct("label", (-F.col("n")).alias("m"), "token"), {"at": F.lit(1)}, "tokens")
    first = rows.groupBy("label").agg(F.min("at").alias("first"))  # a row a label
    return rows.join(F.broadcast(first), "label").select("label", "token", "n", (F.col("at") - F.col("first") + 1).cast("int").alias("rank"))


def vocabulary_sizes(tokens: DataFrame) -> DataFrame:
    """label and its number of different tokens; copies are dropped before they are counted."""
    return tokens.select("label", "token").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("vocabulary"))


def kl_divergence(tokens: DataFrame, eps: float = 1e-10) -> DataFrame:
    """KL divergence of label 0 from label 1 over all tokens, each share raised by eps and renormalised."""
    by = tokens.groupBy("token").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    sums = by.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("v"))
    rows = by.crossJoin(F.broadcast(sums))
    p, q = ((F.col(f"n{c}") / F.col(f"t{c}") + eps) / (1 + eps * F.col("v")) for c in (0, 1))
    return rows.agg(F.sum(p * F.log(p / q)).alias("kl"), F.max("v").alias("vocabulary"))
