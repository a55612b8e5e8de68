"""Synthetic churn table with planted faults, generated by Spark from ``spark.range``.

Every value is a deterministic function of the row id (hash based), so any partitioning gives the same rows.  Used by
tests as ground truth (the reference's only input of known content); no registered check runs on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed shape of the planted faults.
N_ROWS = 2000
N_DUPLICATES = 20
REGIONS = ["North", "South", "East", "West"]


def _u(i, salt: int):
    """Uniform [0, 1) from a hash of (id, salt)."""
    return (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(1_000_003)) / F.lit(1_000_003.0))


def synthetic_churn(spark: SparkSession, n_rows: int = N_ROWS, seed: int = 42) -> DataFrame:
    i = F.col("id")
    u = lambda s: _u(i, seed * 100 + s)
    seg_u = u(6)
    segment = F.when(seg_u < 0.45, "basic").when(seg_u < 0.80, "standard").otherwise("premium")
    churn = F.when(u(10) < 0.3 + 0.2 * (segment == "basic").cast("double"), 1).otherwise(0)
    base = spark.range(n_rows).select(
        F.format_string("C%05d", i).alias("customer_id"),
        (18 + F.floor(u(1) * 62)).cast("long").alias("age"),
        F.when(u(11) < 0.08, None).otherwise(F.round(15000 + u(2) * 100000, 2)).alias("annual_income"),
        F.when(u(12) < 0.05, None).otherwise(F.floor(u(3) * 120).cast("double")).alias("tenure_months"),
        F.when(u(13) < 25.0 / n_rows, 250 + u(4) * 150).otherwise(F.round(-F.log(1 - u(5)) * 20, 3))
        .alias("monthly_usage_gb"),
        segment.alias("segment"),
        F.element_at(F.array(*[F.lit(r) for r in REGIONS]), (F.floor(u(7) * 4) + 1).cast("int")).alias("region"),
        F.when(u(14) < 0.10, None).when(u(15) < 40.0 / n_rows, F.element_at(
            F.array(F.lit("N/A"), F.lit("unknown"), F.lit("—")), (F.floor(u(8) * 3) + 1).cast("int")))
        .otherwise((300 + F.floor(u(9) * 551)).cast("long").cast("string")).alias("credit_score_text"),
        F.when(u(16) < 0.03, None).otherwise(F.date_add(F.lit("2022-01-01").cast("date"),
                                                        F.floor(u(17) * 900).cast("int")).cast("string"))
        .alias("signup_date"),
        (churn + (u(18) - 0.5) * 0.04).alias("leaky_churn_copy"),
        churn.alias("churn"),
        F.lit(None).cast("double").alias("all_null_feature"),
        F.lit("legacy").alias("legacy_flag"),
    )
    dups = base.orderBy(F.xxhash64("customer_id", F.lit(seed))).limit(N_DUPLICATES)
    return base.unionByName(dups)
