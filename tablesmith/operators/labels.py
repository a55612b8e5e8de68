"""Label encoding of a target to 0..n-1 in native sort order, and decoding back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.exprs import qcol
from tablesmith.operators.codes import code_table, join_codes

MAX_LITERAL_LABELS = 200


def fit_labels(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null labels (native order, so 2 sorts before 10): the classes of a model, which keeps one
    set of weights or votes per class anyway. Encoding a column needs no such list, see :func:`label_encode`."""
    distinct = df.select(qcol(col).alias("v")).where(F.col("v").isNotNull()).distinct()
    return sorted(r["v"] for r in distinct.collect())


def encode_expr(col: Column, labels: list) -> Column:
    """Code of each label of a model (null for unseen/null) as INT, by a literal map (no join)."""
    if not labels:
        return F.lit(None).cast("int")
    codes = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
    return F.try_element_at(codes, col).cast("int")


def label_encode(df: DataFrame, col: str, out_col: str | None = None) -> tuple[DataFrame, str]:
    """Return ``(df with out_col = code, path of the code table)``; any number of labels, null for null."""
    path = code_table(df, qcol(col))
    coded = join_codes(df, qcol(col), path, "__label_code")
    return coded.withColumn(out_col or col, F.col("__label_code").cast("int")).drop("__label_code"), path


def encode_target(df: DataFrame, col: str, out_col: str, labels: list | None = None, most: int = MAX_LITERAL_LABELS) -> tuple[DataFrame, list]:
    """``df`` with the label's code as DOUBLE in ``out_col``, and the labels in code order.

    Up to ``most`` labels are coded by literals; more of them by the stored code table, which is joined. Null for null and
    for labels that are not in a given list.
    """
    if labels is None:
        distinct = df.select(qcol(col).alias("v")).where(F.col("v").isNotNull()).distinct()
        few = [r["v"] for r in distinct.limit(most + 1).collect()]
        if len(few) > most:
            coded, path = label_encode(df, col, out_col)
            classes = df.sparkSession.read.parquet(path).orderBy("code").select("value")
            return coded.withColumn(out_col, qcol(out_col).cast("double")), [r["value"] for r in classes.collect()]
        labels = sorted(few)
    return df.withColumn(out_col, encode_expr(qcol(col), labels).cast("double")), labels


def label_decode(df: DataFrame, code_col: str, path: str, out_col: str) -> DataFrame:
    """``df`` with the label of each code, null for a code that the table does not have."""
    codes = df.sparkSession.read.parquet(path).select(F.col("code").alias("__code"), F.col("value").alias("__value"))
    return df.join(codes, qcol(code_col) == F.col("__code"), "left").withColumn(out_col, F.col("__value")).drop("__code", "__value")


def decode_expr(code_col: Column, labels: list) -> Column:
    """Code -> original label (label text restored at scoring time)."""
    arr = F.array(*[F.lit(v) for v in labels])
    return F.element_at(arr, code_col.cast("int") + 1)
