"""Scores a stream of rows with a fitted model, exactly once per micro-batch file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wenloom.operators.models import Model


def score_stream(stream: DataFrame, model: Model, path: str, checkpoint: str) -> StreamingQuery:
    """Writes ``row_id, p`` of all rows there are now as Parquet; ``stream`` has ``row_id, x``."""
    rows = model.transform(stream).select("row_id", "p")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
