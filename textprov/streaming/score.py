"""Scores of a stream of documents: each micro-batch is scored as a batch of its own and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import Predictor


def score_stream(predictor: Predictor, docs: DataFrame, to: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Score the stream ``docs`` (doc_id, text) into Parquet at ``to``: doc_id, p_ai, classification, batch.

    A batch that runs again writes its folder again, so its rows are there once. ``once``: what there is now, then stop.
    """

    def score(rows: DataFrame, batch: int) -> None:
        predictor.classify(rows).write.mode("overwrite").parquet(f"{to}/batch={batch}")

    writer = docs.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
