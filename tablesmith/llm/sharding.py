"""Proportional stratified interleaving into shards (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import cut, number_rows

def interleave_shards(df: DataFrame, stratum: str, key: str, shards: int = 16, seed: int = 7,
                      payload: tuple[str, ...] = ()) -> DataFrame:
    """Assign every row a ``shard`` and a gapless ``slot`` so that each shard has the mixture of the strata.

    Rows are shuffled within their stratum by a seeded hash and ranked; a row of rank r among n gets the fractional
    rank (r + 1/2) / n. All rows are sorted by fractional rank and cut into ``shards`` runs whose lengths differ by at
    most one. Both rankings are exact and split over all tasks, so a stratum that holds most rows is no hot spot.

    ``key`` and ``payload`` columns are returned beside ``shard`` and ``slot``; all other columns, whatever their
    names, are left out. Nulls: a null stratum is a stratum; a null key is ordered first. Rows with equal key and payload
    are interchangeable and each keeps its own slot. An empty table gives an empty result.
    """
    wanted = [key, *payload]
    slim = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("__h"), F.col(stratum).alias("__s"),
                     *[F.col(c).alias(f"__c{i}") for i, c in enumerate(wanted)])
    cols = [f"__c{i}" for i in range(len(wanted))]
    slim = cut(slim, "shard-rows")
    ranked = number_rows(slim, ["__s", "__h", *cols], "__g")
    groups = cut(ranked.groupBy(F.col("__s").alias("__t")).agg(F.min("__g").alias("__first"),
                                                               F.count(F.lit(1)).alias("__size")), "shard-strata")
    total = groups.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    shared = ranked.join(groups, F.col("__s").eqNullSafe(F.col("__t")))
    fraction = ((2 * (F.col("__g") - F.col("__first")) + 1) / (2 * F.col("__size"))).alias("__f")
    placed = number_rows(shared.select(fraction, "__s", "__h", *cols), ["__f", "__s", "__h", *cols], "__pos")
    n = max(int(total), 1)
    shard = F.expr(f"(__pos * {shards}L) div {n}L")
    start = F.expr(f"(__shard * {n}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("__shard", shard)
            .select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(wanted)],
                    F.col("__shard").cast("int").alias("shard"), (F.col("__pos") - start).cast("long").alias("slot")))
