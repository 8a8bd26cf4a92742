"""Scoring a stream: every fitted step is a row-wise expression or a static join."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabulon.plans.prediction import score
from tabulon.session import scratch_path


def score_stream(
    model: PipelineModel, stream: DataFrame, path: str, checkpoint: str | None = None, once: bool = False
) -> StreamingQuery:
    """Append scored rows to a Parquet folder; the checkpoint makes it exactly-once."""
    writer = (
        score(model, stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, "score"))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
