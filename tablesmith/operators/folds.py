"""Cross-validation folds (W1 stratified, W2 shuffled) that do not depend on partitioning.

Both derive from the first 32 bits of md5 of the key, so the assignment is reproducible across runs, clusters and
engines (DuckDB computes the same hash).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.exprs import hash_fraction_key, qcol

# Strata x sub-buckets up to which the offset table of stratified folds is broadcast.
BROADCAST_OFFSET_ROWS = 200_000
ROWS_PER_BUCKET = 2_000_000    # rows ranked by one window task at most (per class and bucket)


def hash_folds(df: DataFrame, key: str, k: int = 3, out: str = "fold") -> DataFrame:
    """``fold = md5-hash(key) % k``; no shuffle, no sort."""
    return df.withColumn(out, (hash_fraction_key(qcol(key)) % k).cast("int"))


def auto_buckets(df: DataFrame, label: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets so that the largest class splits into windows of at most ``rows_per_bucket`` rows."""
    return buckets_for(df.groupBy(qcol(label)).count().agg(F.max("count")).collect()[0][0] or 0, rows_per_bucket)


def buckets_for(largest: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets of a class with ``largest`` rows."""
    return int(max(1, -(-largest // rows_per_bucket)))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 3, buckets: int | str = "auto",
                     out: str = "fold") -> DataFrame:
    """Within each class, rows ranked by ``(h % buckets, h, key)`` with ``h`` the md5 hash of the key, and
    ``fold = rank % k`` — class shares per fold differ by at most one row.

    A class may hold a third of all rows, so the rank is not one window over the class: rows are split into
    ``buckets`` sub-buckets by hash (``"auto"``: enough that the largest class gives windows of at most
    ``ROWS_PER_BUCKET`` rows), ranked inside ``(label, bucket)`` and shifted by the row count of the earlier
    sub-buckets of the same class (a table of classes x buckets rows, broadcast only when its counted size is at
    most ``BROADCAST_OFFSET_ROWS``).
    """
    if buckets == "auto":
        buckets = auto_buckets(df, label)
    h = hash_fraction_key(qcol(key))
    base = df.withColumn("__h", h).withColumn("__b", (F.col("__h") % buckets).cast("int"))
    counts = base.groupBy(qcol(label).alias("__y"), F.col("__b").alias("__cell")).agg(F.count(F.lit(1)).alias("__n"))
    n_cells = counts.count()
    w_cls = Window.partitionBy("__y").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w_cls), F.lit(0))).drop("__n")
    if n_cells <= BROADCAST_OFFSET_ROWS:   # size checked above: broadcast; otherwise an ordinary shuffle join
        offsets = F.broadcast(offsets)
    joined = base.join(offsets, qcol(label).eqNullSafe(F.col("__y")) & (F.col("__b") == F.col("__cell"))).drop("__y", "__cell")
    w = Window.partitionBy(qcol(label), F.col("__b")).orderBy("__h", qcol(key))
    rank = F.col("__off") + F.row_number().over(w) - 1
    return joined.withColumn(out, (rank % k).cast("int")).drop("__h", "__b", "__off")
