"""Seeded samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.exprs import hash_fraction_key, qcol


def sample_n(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement: the ``n`` smallest md5 hashes of ``key[0]`` and the seed (ties by the
    key columns).  Plans as TakeOrderedAndProject: every task keeps its own top n, so nothing large moves."""
    h = hash_fraction_key(F.concat(qcol(key[0]).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(h, *[qcol(k).asc_nulls_first() for k in key]).limit(n)


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample of about ``fraction`` of the rows."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
