"""Scoring a stream with a fitted pipeline or model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, fitted) -> DataFrame:
    """The stream with the fitted object's output: prediction is a projection, without state or shuffle."""
    if not stream.isStreaming:
        raise ValueError("score_stream needs a streaming DataFrame")
    return fitted.predict(stream)


def write_scores(scored: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append scores to Parquet, exactly once per input row; ``once`` stops when the input is read."""
    writer = scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
