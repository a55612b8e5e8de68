"""Dataset catalog = JSON manifest plus default entries whose id is not already listed, and the same rule as a keyed
merge into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.exprs import qcol


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest file: a JSON array of entries with at least ``id``, ``path``, ``target_column``."""
    return spark.read.option("multiLine", True).json(path)


def add_missing(catalog: DataFrame, defaults: DataFrame, key: str = "id") -> DataFrame:
    """Append the default entries whose key is absent (left-anti join), columns aligned by name."""
    missing = defaults.join(catalog.select(key).distinct(), key, "left_anti")
    return catalog.unionByName(missing, allowMissingColumns=True)


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def catalog_entries(spark: SparkSession, root: str, tables: list[str], target_of: dict[str, str]) -> DataFrame:
    """Entries for parquet tables under ``root`` (id, path, target_column)."""
    rows = [(t, f"{root}/{t}.parquet", target_of.get(t)) for t in tables]
    return spark.createDataFrame(rows, "id string, path string, target_column string").withColumn(
        "problem_type", F.lit(None).cast("string"))


# ---------------------------------------------------------------------------------------------------------------
# Versioned tables
# ---------------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> int:
    """The highest committed version of a versioned table, 0 where there is none."""
    hadoop, fs = _files(spark, path)
    folder = hadoop(f"{path}/_committed")
    if not fs.exists(folder):
        return 0
    return max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table (the current one by default). Readers of an older one are not disturbed by later merges."""
    version = current_version(spark, path) if version is None else version
    if not version:
        raise FileNotFoundError(f"no version of a table at {path}")
    return spark.read.parquet(f"{path}/v{version}")


def _commit(spark: SparkSession, path: str, version: int) -> None:
    """Make a written version current: its marker appears in one step, after all of its files."""
    hadoop, fs = _files(spark, path)
    if not fs.createNewFile(hadoop(f"{path}/_committed/{version}")):
        raise RuntimeError(f"version {version} of {path} was committed by another writer")


def merge_versioned(spark: SparkSession, path: str, batch: DataFrame, key: str) -> int:
    """D3 on a stored table: rows of ``batch`` whose key the table does not have are added in a new version; returns the current
    version.

    The merge is idempotent: a batch that adds nothing (such as a repeated one) makes no version, and a merge that failed
    half way left no committed one. Rows of one key in a batch count once (the smallest row); null is a key.
    """
    fields = [qcol(c).alias(f"c{i}") for i, c in enumerate(batch.columns)]
    place = batch.columns.index(key)
    one = batch.select(*fields).groupBy(F.col(f"c{place}").alias("k")).agg(F.min(F.struct(*[f"c{i}" for i in range(len(fields))])).alias("r"))
    rows = one.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(batch.columns)])
    version = current_version(spark, path)
    if version:
        base = read_version(spark, path, version)
        known = base.select(qcol(key).alias("__known"))
        missing = rows.join(known, qcol(key).eqNullSafe(F.col("__known")), "left_anti")
        if missing.isEmpty():
            return version
        rows = base.unionByName(missing, allowMissingColumns=True)
    rows.write.mode("overwrite").parquet(f"{path}/v{version + 1}")
    _commit(spark, path, version + 1)
    return version + 1
