"""Headered CSV in, with the NA token list and our own type inference (one aggregate job).

Everything is read as text first; CSV-reader NA tokens become null; a column whose non-null values are all integers
becomes LONG, all numbers DOUBLE, all true/false BOOLEAN; anything else (dates included) stays text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.exprs import NA_TOKENS, NUMBER_PATTERN, qcol
from tablesmith.operators.aggs import collect_agg

INT_PATTERN = r"^\s*[+-]?\d+\s*$"
BOOL_PATTERN = r"^(?i)(true|false)$"


def read_text_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """All columns as text, NA tokens as null. ``multiline`` reads quoted line breaks (a file is then one task)."""
    df = spark.read.option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"').option("inferSchema", False).option("mode", "FAILFAST").csv(path)
    if not df.columns:
        raise ValueError(f"there is no header line to name columns in {path}")
    return df.select(*[F.when(qcol(c).isin(NA_TOKENS), None).otherwise(qcol(c)).alias(c) for c in df.columns])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to LONG / DOUBLE / BOOLEAN when every non-null value fits (one aggregate)."""
    aggs = []
    for i, c in enumerate(df.columns):
        x = qcol(c)
        whole = x.rlike(INT_PATTERN) & F.trim(x).try_cast("long").isNotNull()  # beyond a long it is a number
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(whole).alias(f"i{i}"),
                 F.count_if(x.rlike(NUMBER_PATTERN)).alias(f"d{i}"), F.count_if(x.rlike(BOOL_PATTERN)).alias(f"b{i}")]
    row = collect_agg(df, aggs)
    out = []
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        x = qcol(c)
        if n and row[f"i{i}"] == n:
            out.append(F.trim(x).cast("long").alias(c))
        elif n and row[f"d{i}"] == n:
            out.append(F.trim(x).cast("double").alias(c))
        elif n and row[f"b{i}"] == n:
            out.append(F.lower(x).cast("boolean").alias(c))
        elif n == 0:
            out.append(x.cast("double").alias(c))  # an all-empty column reads as a float column
        else:
            out.append(x)
    return df.select(*out)


def load_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Read, null the NA tokens, infer types; raises when the file has no rows."""
    df = infer_types(read_text_csv(spark, path, multiline))
    if df.isEmpty():
        raise ValueError(f"CSV at {path} has no rows")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """Headered CSV with plain timestamps (the form S1 reads back)."""
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss") \
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
