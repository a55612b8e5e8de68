"""Q1: named data-quality checks ``(check, pass, detail)`` and their pass rate in percent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_rows(checks: list[DataFrame]) -> DataFrame:
    """Union of one-row check frames, each ``(check STRING, pass BOOLEAN, detail STRING)``."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def pass_rate(checks: DataFrame) -> DataFrame:
    return checks.agg((100.0 * F.avg(F.col("pass").cast("double"))).alias("pass_rate"),
                      F.count(F.lit(1)).alias("n_checks"))
