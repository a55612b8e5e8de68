"""Parquet snapshot of a prepared table (nulls stay null; text is never forced to strings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_snapshot(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        raise FileNotFoundError(f"no snapshot at {path}") from e
