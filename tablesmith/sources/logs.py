"""Append records to a log table (batch append or a streaming file sink) — never read-concat-rewrite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_records(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("append")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_records(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    r = spark.read.schema(schema)
    return r.option("header", True).csv(path) if fmt == "csv" else r.format(fmt).load(path)


def append_records_stream(stream_df: DataFrame, path: str, checkpoint: str, fmt: str = "csv",
                          available_now: bool = True):
    """S6 for arriving records: a file sink appends each micro-batch exactly once (checkpointed)."""
    w = stream_df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if fmt == "csv":
        w = w.option("header", True)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
