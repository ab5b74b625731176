"""Reading of the tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; zone-less timestamps mean UTC and become instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    casts = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(casts) if casts else df
