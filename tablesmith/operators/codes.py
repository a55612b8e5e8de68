"""Code tables: every distinct value of a column and its 0-based rank in native sort order, as a stored table.

The ranks come from a range sort and per-partition offsets, so any number of values is coded without a one-task window or
a list on the driver. Encoding joins the stored table, whose size Spark knows: it is broadcast only below the session's
broadcast threshold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.session import scratch_path


def store(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, f"{name}_{uuid.uuid4().hex}")
    df.write.parquet(path)
    return path


def code_table(df: DataFrame, value: Column) -> str:
    """Write ``(value, code LONG)`` for the distinct non-null values and return its path."""
    spark = df.sparkSession
    distinct = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct()
    placed = spark.read.parquet(store(distinct.repartitionByRange("value").sortWithinPartitions("value")
                                      .withColumn("place", F.monotonically_increasing_id()), "sorted_values"))
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = placed.join(F.broadcast(offsets), part == F.col("part"))
    return store(ranked.select("value", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("code")), "codes")


def join_codes(df: DataFrame, value: Column, path: str, out: str) -> DataFrame:
    """``df`` with ``out``: the value's code, null for null and unseen values."""
    codes = df.sparkSession.read.parquet(path).select(F.col("value").alias("__code_value"), F.col("code").alias("__code"))
    joined = df.withColumn("__coded", value).join(codes, F.col("__coded") == F.col("__code_value"), "left")
    return joined.withColumn(out, F.col("__code")).drop("__coded", "__code_value", "__code")
