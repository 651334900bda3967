"""Command line: score a text, a file, lines, a JSON array or standard input by a saved model."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import score
from .sources import artifacts, texts

FORMATS = ("class", "class-id", "probability", "json", "human")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="textprov", description="Score texts by a saved model.")
    given = out.add_mutually_exclusive_group()
    given.add_argument("text", nargs="?", help="the text; standard input if no source is given")
    given.add_argument("-f", "--file", help="a file with one text")
    given.add_argument("-b", "--batch", help="a file with a text on each line")
    given.add_argument("--batch-json", help="a file with a JSON array of texts")
    out.add_argument("-o", "--format", choices=FORMATS, default="probability")
    out.add_argument("-t", "--threshold", type=float, help="probability from which a text counts as AI; the model's own by default")
    out.add_argument("--labels", default="human,ai", help="two names for the classes, with a comma between")
    out.add_argument("--model", help="folder of the model; else the one in the cache")
    loud = out.add_mutually_exclusive_group()
    loud.add_argument("-q", "--quiet", action="store_true")
    loud.add_argument("-v", "--verbose", action="store_true", help="time taken, to standard error")
    out.add_argument("--no-color", action="store_true", help="accepted; output has no colours")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(args)
    labels = tuple(a.labels.split(","))
    if len(labels) != 2:
        p.error("--labels takes two names")
    spark = spark or SparkSession.builder.appName("textprov").getOrCreate()
    predictor = score.Predictor.load(spark, str(artifacts.resolve(local=a.model)))
    threshold = predictor.threshold if a.threshold is None else a.threshold
    began = time.time()
    docs, batch = texts.source(spark, a.text, a.file, a.batch, a.batch_json)
    line = score.formatted(F.col("p_ai"), a.format, threshold, labels).alias("line")
    rows = predictor.predict(docs).orderBy("doc_id").select(line)
    if batch and not a.quiet and a.format != "json":
        print("Scoring ...", file=sys.stderr)
    found, n = rows.toLocalIterator(), 0
    if batch and a.format == "json":
        sys.stdout.write("[")
    for n, r in enumerate(found, 1):
        sys.stdout.write(("," if n > 1 else "") + r["line"] if batch and a.format == "json" else r["line"] + "\n")
    if batch and a.format == "json":
        sys.stdout.write("]\n")
    if a.verbose:
        print(f"{n} texts in {time.time() - began:.2f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
