"""Scoring of streams (an extension): a fitted model is row-local, so a stream is scored like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(stream: DataFrame, model, path: str, checkpoint: str) -> StreamingQuery:
    """Append predictions as Parquet; stateless, exactly once per input file."""
    return model.transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
