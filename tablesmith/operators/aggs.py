"""Global aggregates over many columns, chunked so generated code stays compilable.

One ``agg`` with thousands of aggregate expressions generates a Java method too large to compile (Spark then falls
back to interpreted evaluation).  ``collect_agg`` runs at most ``AGG_CHUNK`` expressions per job: up to that width
it is a single job, wider tables take ceil(n / AGG_CHUNK) scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

AGG_CHUNK = 160


def collect_agg(df: DataFrame, aggs: list[Column], chunk: int = AGG_CHUNK) -> dict:
    """Evaluate aliased aggregate expressions; returns ``{alias: value}``."""
    out: dict = {}
    for start in range(0, len(aggs), chunk):
        row = df.agg(*aggs[start:start + chunk]).collect()[0]
        out.update(row.asDict())
    return out
