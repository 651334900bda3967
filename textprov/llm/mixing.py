"""Mixing sources to target weights: budgets down a tree of domain, language and source.

Capacities (tokens times ``max_epochs``) are added up from the leaves. From the root down, a node's
budget is shared among its children by weight; a child never gets more than its capacity, and what it
can't take goes to its siblings by their weights. So a shortage is met within the parent first, and
only what a whole subtree can't hold reaches the parent's siblings.

A child gets ``min(capacity, weight * level)`` with one level for all children of a parent. The level is
found without gathering them: capacities and weights are added up by BINS ranges an octave of capacity /
weight, and only the range where the budget ends is ordered. So there may be any number of leaves.

A leaf of budget b and t tokens gives ``b // t`` whole epochs and of the next one a prefix of its texts,
in the order of the epoch's seeded hash, whose tokens sum to no more than what is left. The prefix is
found without sorting the leaf: tokens are added up by 4096 ranges of the hash, and only the range where
the budget ends, a 4096th of the leaf, is ordered. Tokens are those of a tokenizers file.

Defined results: a null text has 0 tokens and goes into whole epochs and prefixes for nothing; null
names are ''; names without a weight have weight 1, names of weight 0 get nothing; equal hashes are
ordered by doc_id, nulls first, then as placed in the files; rows repeated with one id are rows of their
own; an empty table gives no rows. ``mix`` passes on all columns, whatever they are called, and
``shares`` reads only those it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, textscan, wordcache

SEED, MAX_EPOCHS, SHARE = 42, 2, 0.8
LEVELS = ("domain", "lang", "source")
#: Ranges an octave of capacity / weight.
BINS = 64

#: Of op9 and the pipeline: domains of the sources, and weights by level. What isn't listed is 'other' and weighs 1.
DOMAINS = {f"src{i}": "web" if i < 7 else "reference" for i in range(14)}
WEIGHTS = {"domain": {"web": 5, "reference": 3, "other": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}


def _named(names: dict, column: F.Column, other) -> F.Column:
    if not names:
        return F.lit(other)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[column], F.lit(other))


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (columns ``parent``, w, capacity, pool) with ``given``: the pool of a parent is shared by weight up to each capacity.

    With r = capacity / w, a child of ratio r is full where the capacities of all of smaller ratio and r
    times the weights of the others fit the pool; this need grows with r, so the full ones are those up to a ratio.
    """
    live = children.filter("w > 0 AND capacity > 0")
    ratio = F.col("capacity") / F.col("w")
    steps = live.groupBy(*parent, ratio.alias("ratio")).agg(F.sum("w").alias("w"), F.sum("capacity").alias("capacity"), F.max("pool").alias("pool"))
    steps = shared.written(steps.withColumn("bin", F.floor(F.log2("ratio") * BINS)), "ratios")
    bins = steps.groupBy(*parent, "bin").agg(F.sum("w").alias("w"), F.sum("capacity").alias("capacity"), F.min("ratio").alias("ratio"), F.max("pool").alias("pool"))
    whole, before = Window.partitionBy(*parent), Window.partitionBy(*parent).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(  # a few thousand rows a parent at most
        *parent, "bin", "ratio", "pool", F.sum("w").over(whole).alias("total"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}_before") for c in ("w", "capacity")),
    )
    bins = shared.written(bins, "bins")
    need = F.col("capacity_before") + F.col("ratio") * (F.col("total") - F.col("w_before"))
    last = bins.filter(need <= F.col("pool")).groupBy(*parent).agg(F.max_by(F.struct("bin", "total", "w_before", "capacity_before"), "bin").alias("last"))
    # the range where the pool ends: its ratios in order
    within = Window.partitionBy(*parent).orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = _on(steps, last, parent).filter(F.col("bin") == F.col("last.bin"))
    inside = inside.select(*parent, "ratio", "pool", F.col("last.total").alias("total"), F.col("w").alias("mine"), F.col("capacity").alias("cap"),
                           *((F.col(f"last.{c}_before") + F.sum(c).over(within)).alias(f"{c}_full") for c in ("w", "capacity")))
    need = F.col("capacity_full") - F.col("cap") + F.col("ratio") * (F.col("total") - F.col("w_full") + F.col("mine"))
    full = inside.filter(need <= F.col("pool")).groupBy(*parent).agg(F.max_by(F.struct("ratio", "w_full", "capacity_full", "total", "pool"), "ratio").alias("full"))
    left, weight = F.col("full.pool") - F.col("full.capacity_full"), F.col("full.total") - F.col("full.w_full")
    # all are full, or none: then the level is pool / total
    full = full.select(*parent, F.col("full.ratio").alias("full_to"), (left / F.when(weight > 1e-9 * F.col("full.total"), weight)).alias("level"))
    sums = bins.groupBy(*parent).agg((F.max("pool") / F.max("total")).alias("even"))
    out = _on(children, _on(sums, full, parent), parent)
    given = F.when(ratio <= F.col("full_to"), F.col("capacity")).otherwise(F.least("capacity", F.col("w") * F.coalesce("level", "even")))
    return out.select(*children.columns, F.when((F.col("w") > 0) & (F.col("capacity") > 0), given).otherwise(0.0).alias("given"))


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``; without keys both are one group, so ``right`` is one row."""
    return left.join(right, keys, "left") if keys else left.join(F.broadcast(right), how="left")


def budgets(leaves: DataFrame, weights: dict, budget: float, max_epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, n) with ``budget``: whole tokens of each leaf."""
    rows = leaves
    for name in LEVELS:
        rows = rows.withColumn(f"w_{name}", _named({k: float(v) for k, v in weights.get(name, {}).items()}, F.col(name), 1.0))
    counts = F.least(*(F.col(f"w_{n}") for n in LEVELS)) > 0
    rows = shared.written(rows.withColumn("capacity", F.when(counts, F.col("n") * float(max_epochs)).otherwise(0.0)), "leaves")
    pools = None
    for depth in range(len(LEVELS)):
        keys, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        children = rows.groupBy(*keys).agg(F.first(f"w_{LEVELS[depth]}").alias("w"), F.sum("capacity").alias("capacity"))
        children = shared.written(children.join(pools, parent) if parent else children.withColumn("pool", F.lit(float(budget))), "children")
        pools = shared.written(fill(children, parent).select(*keys, F.col("given").alias("pool")), "pools")
    return rows.select(*LEVELS, "n").join(pools, list(LEVELS)).select(*LEVELS, "n", F.floor(F.col("pool") + 1e-6).alias("budget"))


def counted(docs: DataFrame, domains: dict[str, str], tokenizer: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, ``carry`` and a row number; written."""
    shared.small_batches(docs.sparkSession)
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    names = [source.alias("source"), _named(domains, source, "other").alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *names, *carry, F.monotonically_increasing_id().alias("nr"), "text")
    fields = rows.schema[:-1]
    kept = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordcache.encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in textscan.blocks(batch["text"]):
                columns = [batch[c].slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(encoder.counts(data, offsets).astype("int64"))], names=[*kept, "n_tokens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return shared.written(rows.mapInArrow(run, f"{schema}, n_tokens long"), "counted")


def shares(docs: DataFrame, tokenizer: str, weights: dict | None = None, domains: dict | None = None, budget: int | None = None, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, domain, lang, source, n_tokens, copies (and ``carry``). ``budget``: tokens, else ``share`` of all."""
    keys = list(LEVELS)
    rows = counted(docs, domains or {}, tokenizer, carry).withColumn("leaf", F.struct(*keys))
    leaves = shared.written(rows.groupBy(*keys).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")), "sizes")
    total = leaves.agg(F.sum("n")).first()[0] or 0
    plan = budgets(leaves.drop("rows"), weights or {}, share * total if budget is None else budget, max_epochs)
    whole = F.when(F.col("n") > 0, F.least(F.floor(F.col("budget") / F.greatest("n", F.lit(1))), F.lit(max_epochs))).otherwise(F.when(F.col("budget") > 0, max_epochs).otherwise(0))
    plan = plan.select(*keys, whole.cast("long").alias("whole"), F.when(F.col("n") > 0, F.col("budget") % F.greatest("n", F.lit(1))).otherwise(0).alias("rest"))
    plan = plan.join(leaves.select(*keys, "rows"), keys).select(F.struct(*keys).alias("leaf"), "whole", "rest", "rows")
    placed = shared.join_groups(rows, shared.written(plan, "plan"), "leaf", "rows")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = shared.written(placed.withColumn("order", order).withColumn("range", F.substring("order", 1, 3)), "placed")
    ranges = placed.filter("rest > 0").groupBy("leaf", "range").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("rows").alias("rows"))
    before = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = ranges.filter("before + n > rest").groupBy("leaf").agg(F.min("range").alias("cut"), F.min("before").alias("before"), F.first("rows").alias("of"))
    placed = shared.join_groups(placed, shared.written(cut, "cuts"), "leaf", "of")
    at_cut = F.col("range") == F.col("cut")
    sums = Window.partitionBy("leaf").orderBy("order", "doc_id", *carry, "nr")
    fits = placed.filter(at_cut).withColumn("more", F.col("before") + F.sum("n_tokens").over(sums.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("rest"))
    rest = placed.filter(~F.coalesce(at_cut, F.lit(False))).withColumn("more", (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("range") < F.col("cut"))))
    both = fits.unionByName(rest)
    return both.select("doc_id", *keys, "n_tokens", (F.col("whole") + F.col("more").cast("long")).alias("copies"), *carry)


def mix(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say, all columns; decisions are applied where rows are read, so no text is shuffled."""
    docs, file, row = shared.located(docs)
    with shared.scratch() as stays:
        rows = docs.select("doc_id", "text", "lang", "source", file.alias("file"), row.alias("row"))
        out = shares(rows, tokenizer, carry=("file", "row"), **settings).filter("copies <> 1")
        folder = shared.save_decisions(out.select("file", "row", F.col("copies").alias("value")), "copies")
        stays.append(folder)
    return shared.copies(docs, file, row, folder, 1)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shares(docs, public_tokenizers.path("byte_bpe_50k.json"), WEIGHTS, DOMAINS)
