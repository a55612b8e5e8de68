"""Faults that once gave wrong answers, each on a table where it matters."""

import math

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import models as M
from tablesmith.operators import prep as ops
from tablesmith.operators import profile as P
from tablesmith.operators.quantiles import quantiles
from tablesmith.operators.training import cv_predictions, feature_table
from tablesmith.plans.prep_fit import fit_prep, prep_dataframe
from tablesmith.plans.spec import PrepPlan
from tablesmith.sources.csv import load_csv


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (nan, 0), (3.0, 1), (None, 1)], "x double, y int")
    x = {"x": F.col("x")}
    assert ops.fit_fills(df, x, {"x": "mean"}, {"x": True}) == {"x": 2.0}
    assert ops.fit_scalers(df, x)["x"][1] == 2.0 and quantiles(df, x, [0.5])["x"] == [2.0]
    assert sorted(r.x for r in ops.apply_fill(df, "x", 9.0).collect()) == [1.0, 2.0, 3.0, 9.0, 9.0]


def test_quantiles_of_tiny_columns(spark):
    for values in ([5.0], [1.0, 2.0], [3.0, 1.0, 2.0], [1.0] * 7 + [9.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        got = quantiles(df, {"x": F.col("x"), "none": F.lit(None).cast("double")}, [0.0, 0.25, 0.5, 0.75, 1.0])
        s = sorted(values)
        want = [s[math.floor(p * (len(s) - 1))] + (s[math.ceil(p * (len(s) - 1))] - s[math.floor(p * (len(s) - 1))]) * (p * (len(s) - 1) % 1)
                for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
        assert got["x"] == pytest.approx(want) and got["none"] == [None] * 5


def test_colliding_onehot_names_are_rejected(spark):
    df = spark.createDataFrame([("b_q", "q", i % 2) for i in range(4)] + [("z", "w", 1)] * 2, "a string, a_b string, y int")
    with pytest.raises(ValueError, match="a_b_q"):
        fit_prep(df, "y", PrepPlan(encode={"a": "onehot", "a_b": "onehot"}))


def test_before_drop_keeps_rows_that_differ_in_dropped_columns(spark):
    df = spark.createDataFrame([(i // 2, i % 3, i % 2) for i in range(30)], "id int, x int, y int")
    out, spec = prep_dataframe(df, "y", PrepPlan(drop_cols=["id"], dedupe="before_drop"))
    assert out.count() == 30 and spec.dedupe == "before_drop"


def test_more_categories_than_a_literal_holds(spark):
    rows = [(f"c{i:04d}", i % 2) for i in range(300)] + [("c0001", 0)]
    df = spark.createDataFrame(rows, "c string, y int")
    out, spec = prep_dataframe(df, "y", PrepPlan(encode={"c": "ordinal"}, scale_strategy="none", iqr_k=None))
    assert sorted({int(r.c) for r in out.collect()}) == list(range(300)) and spec.ordinal["c"]["size"] == 300
    wide, spec = prep_dataframe(df, "y", PrepPlan(encode={"c": "onehot"}, scale_strategy="none", iqr_k=None))
    assert len(spec.onehot["c"]) == 300 and len(wide.columns) == 301


def test_integers_beyond_doubles(spark):
    df = spark.range(1000).select((F.lit(2**60) + F.col("id")).alias("k"))
    assert P.cardinality(df).first()["cardinality"] == 1000


def test_repeated_rows_are_predicted_once_each(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("x"), (F.col("id") % 2).alias("y"))
    ft = feature_table(df, "y", "classification", cv=3)
    assert ft.df.select("row_id").distinct().count() == 60
    assert cv_predictions(ft, "KNN", None, 3).count() == 60
    ft.release()


def test_estimator_hook(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression
    monkeypatch.setitem(M.ESTIMATOR_HOOKS, "GradientBoostingDeep", lambda kind, params, seed: LogisticRegression(regParam=params.get("r", 0.5)))
    assert M.build_estimator("GradientBoostingDeep", "classification", {"r": 0.25}).getRegParam() == 0.25
    with pytest.raises(ValueError, match="Nope"):
        M.build_estimator("Nope", "classification")


def test_csv_line_breaks_and_long_integers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"two\nlines",12345678901234567890\nx,1\n')
    rows = load_csv(spark, str(path), multiline=True).collect()
    assert [(r.a, r.b) for r in rows] == [("two\nlines", 1.2345678901234567e19), ("x", 1.0)]


def test_cluster_without_shared_folder_is_an_error(monkeypatch):
    from tablesmith import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
