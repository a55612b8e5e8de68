"""Edge cases: NaN, booleans, nested columns, empty tables, large category sets, unseen categories."""

import math

import pytest
from pyspark.sql import functions as F

from tablesmith.operators.profile import missingness, outliers_iqr
from tablesmith.operators.prep import fit_encoders, transform_encoders
from tablesmith.plans.prep_fit import apply_prep, fit_prep
from tablesmith.plans.spec import PrepPlan


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double")
    row = {r["column_name"]: r["missing_fraction"] for r in missingness(df).collect()}
    assert row["x"] == 0.5


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, y string")
    assert {r["missing_fraction"] for r in missingness(df).collect()} == {0.0}
    o = outliers_iqr(df, "x").collect()[0]
    assert math.isnan(o["lower_bound"]) and o["n_outliers"] == 0 and o["outlier_fraction"] == 0.0


def test_boolean_feature_becomes_number_and_is_not_clipped(spark):
    rows = [(i, i % 3 == 0, float(i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, flag boolean, x double, y int")
    spec = fit_prep(df, "y")
    assert "flag" in spec.bool_columns and "flag" not in spec.clip_bounds and "flag" in spec.scalers
    out = apply_prep(df, spec)
    assert dict(out.dtypes)["flag"] == "double"


def test_nested_column_is_rejected(spark):
    df = spark.createDataFrame([([1, 2], 1), ([3], 0)], "a array<int>, y int")
    with pytest.raises(TypeError):
        fit_prep(df, "y")
    spec = fit_prep(df, "y", PrepPlan(drop_cols=["a"]))
    assert spec.output_columns == ["y"]


def test_target_encoding_with_lookup_table(spark):
    rows = [(f"k{i % 300}", float(i % 7), i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, x double, y int")
    plan = PrepPlan(encode={"key": "target"}, iqr_k=None, scale_strategy="none")
    spec = fit_prep(df, "y", plan)
    assert "path" in spec.target_maps["key"] and spec.target_maps["key"]["size"] == 300
    # fit statistics come from the de-duplicated training rows
    expect = {r["key"]: r["m"] for r in df.dropDuplicates().groupBy("key").agg(F.avg("y").alias("m")).collect()}
    scored = apply_prep(df.withColumn("key_raw", F.col("key")), spec, "score", keep=["key_raw"])
    got = {r["key_raw"]: r["key"] for r in scored.select("key_raw", "key").distinct().collect()}
    assert len(got) == 300
    assert all(got[k] == pytest.approx(expect[k]) for k in expect)
    unseen = spark.createDataFrame([("never", 1.0, 0)], "key string, x double, y int")
    gm = spec.target_maps["key"]["global_mean"]
    assert apply_prep(unseen, spec, "score").collect()[0]["key"] == pytest.approx(gm)


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    st = fit_encoders(train, ["c"], "onehot")
    rows = transform_encoders(test, st).collect()
    assert [(r["c_a"], r["c_b"]) for r in rows] == [(1, 0), (0, 0), (0, 0)]
    st = fit_encoders(train, ["c"], "ordinal")
    assert [r["c"] for r in transform_encoders(test, st).collect()] == [0.0, -1.0, -1.0]


def test_approx_profile_is_close(spark):
    from tests.conftest import SF_SMALL
    from tablesmith.operators.profile import column_profile
    from tablesmith.sources.tables import load_table
    li = load_table(spark, SF_SMALL, "lineitem")
    exact = {r["column_name"]: r["cardinality"] for r in column_profile(li).collect()}
    approx = {r["column_name"]: r["cardinality"] for r in column_profile(li, approx=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[c] - exact[c]) <= max(2, 0.05 * exact[c]) for c in exact)
