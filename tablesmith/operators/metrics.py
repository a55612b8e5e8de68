"""Evaluation metrics (A16–A18) as aggregates over prediction tables.

Classification metrics go through confusion counts ``groupBy(y, p)`` (map-side combined, at most classes^2 rows), so
their cost is one scan whatever the row count.  F1 is the per-label F1 averaged over the labels seen in y or p (macro),
or the F1 of the positive label (binary: the second label in sorted order); undefined F1 counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.exprs import qcol

CLASSIFICATION_METRICS = ("accuracy", "f1")
REGRESSION_METRICS = ("mae", "rmse", "r2")
SMALLER_IS_BETTER = ("rmse", "mae")


def _per_label(cm: DataFrame, group: list[str]) -> DataFrame:
    """From confusion counts ``(*group, y, p, n)`` to ``(*group, label, tp, pp, ap)``."""
    g = [F.col(c) for c in group]
    contrib = cm.select(*g, F.inline(F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("long").alias("pp"), F.col("n").alias("ap")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("pp"),
                 F.lit(0).cast("long").alias("ap")))))
    return contrib.groupBy(*group, "label").agg(F.sum("tp").alias("tp"), F.sum("pp").alias("pp"),
                                                 F.sum("ap").alias("ap"))


def _f1(tp: Column, pp: Column, ap: Column) -> Column:
    return F.when(pp + ap == 0, F.lit(0.0)).otherwise(2.0 * tp / (pp + ap))


def confusion_counts(df: DataFrame, y: Column, p: Column, group: list[Column] = ()) -> DataFrame:
    return df.groupBy(*group, y.cast("string").alias("y"), p.cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_scores(cm: DataFrame, group: list[str], average: str, pos_label: str | None = None) -> DataFrame:
    """``(*group, accuracy, f1)`` from confusion counts."""
    acc = cm.groupBy(*group).agg((F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) /
                                  F.sum("n")).alias("accuracy"))
    pl = _per_label(cm, group)
    if average == "macro":
        f1 = pl.groupBy(*group).agg(F.avg(_f1(F.col("tp"), F.col("pp"), F.col("ap"))).alias("f1"))
    else:
        f1 = pl.where(F.col("label") == F.lit(pos_label)).groupBy(*group).agg(
            F.max(_f1(F.col("tp"), F.col("pp"), F.col("ap"))).alias("f1"))
        f1 = acc.select(*group).join(f1, group, "left").select(*group, F.coalesce("f1", F.lit(0.0)).alias("f1"))
    return acc.join(f1, group, "left")


def smallest_labels(df: DataFrame, label: Column, most: int = 3) -> list:
    """The smallest labels in native order. Three of them tell what the averages ask: are there more than two, and which one
    is the second?"""
    seen = df.select(label.alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v").limit(most)
    return [r["v"] for r in seen.collect()]


def classification_metrics(df: DataFrame, y: str, p: str, average: str | None = None,
                           labels: list | None = None) -> DataFrame:
    """One row ``(accuracy, f1)``; ``average`` defaults to binary for <= 2 labels of y, else macro."""
    cm = confusion_counts(df, qcol(y), qcol(p), [F.lit(0).alias("__g")])
    if labels is None:
        labels = smallest_labels(df, qcol(y))
    if average is None:
        average = "binary" if len(labels) <= 2 else "macro"
    pos = str(labels[1]) if average == "binary" and len(labels) > 1 else None
    return classification_scores(cm, ["__g"], average, pos).drop("__g")


def regression_scores(df: DataFrame, y: Column, p: Column, group: list[Column] = ()) -> DataFrame:
    """``(*group, mae, rmse, r2)`` in one aggregate; R^2 = 1 - SSE/SST."""
    e = p.cast("double") - y.cast("double")
    n = F.count(F.lit(1))
    sst = F.var_pop(y.cast("double")) * n
    return df.groupBy(*group).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row ``(mae, rmse, r2)``."""
    return regression_scores(df, qcol(y), qcol(p))


def fold_scores(df: DataFrame, label: str, predictions: dict[str, Column], fold_col: str, problem_type: str,
                labels: list | None = None) -> DataFrame:
    """Long score table ``(model_id, fold, metric, score)`` for several prediction columns at once: the models
    are unpivoted next to the label so all folds and models share one aggregation."""
    structs = [F.struct(F.lit(m).alias("model_id"), e.alias("p")) for m, e in predictions.items()]
    long = df.select(qcol(label).alias("__y"), F.col(fold_col).cast("int").alias("fold"),
                     F.inline(F.array(*structs)))
    if problem_type == "classification":
        if labels is None:
            labels = smallest_labels(df, qcol(label))
        average = "binary" if len(labels) <= 2 else "macro"
        pos = str(labels[1]) if average == "binary" and len(labels) > 1 else None
        cm = confusion_counts(long, F.col("__y"), F.col("p"), [F.col("model_id"), F.col("fold")])
        wide = classification_scores(cm, ["model_id", "fold"], average, pos)
        metrics = CLASSIFICATION_METRICS
    else:
        wide = regression_scores(long, F.col("__y"), F.col("p"), [F.col("model_id"), F.col("fold")])
        metrics = REGRESSION_METRICS
    return wide.select("model_id", "fold", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics])))


def cv_summary(scores: DataFrame) -> DataFrame:
    """``(model_id, metric, mean_score, std_score, n_folds)`` with the population std over folds."""
    return scores.groupBy("model_id", "metric").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"),
        F.count("score").alias("n_folds"))
