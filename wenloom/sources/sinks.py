"""Writers of the pipeline's tables: Parquet by split, with metadata as JSON beside it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def write_by_split(df: DataFrame, path: str, about: dict | None = None) -> None:
    """One folder per ``split``, so that readers of one split list only its files; ``about`` as one JSON line."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    if about is not None:
        line = json.dumps(about, ensure_ascii=False)
        df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_by_split(spark, path: str, split: str | None = None) -> DataFrame:
    """All rows or those of one split; a missing table raises."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows if split is None else rows.where(rows["split"] == split)


def read_about(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/about").first()[0])
