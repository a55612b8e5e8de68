"""Wide tables: fit, correlations and leakage checks over hundreds of columns (chunked aggregates, Gram sums)."""

from pyspark.sql import functions as F

from tablesmith.operators.leakage import leaked_features
from tablesmith.operators.profile import correlation_flags, correlation_matrix
from tablesmith.plans.prep_fit import apply_prep, fit_prep

N_COLS = 240


def _wide(spark):
    i = F.col("id")
    cols = [(F.xxhash64(i, F.lit(k)) % 1000).cast("double").alias(f"x{k}") for k in range(N_COLS)]
    cols.append(F.when(i % 7 == 0, None).otherwise((i % 5).cast("string")).alias("txt"))
    y = (i % 2).cast("int")
    return spark.range(3000).select(*cols, (y * 100 + (i % 3)).cast("double").alias("leak"), y.alias("y"))


def test_wide_fit_and_apply(spark):
    df = _wide(spark)
    spec = fit_prep(df, "y")
    assert len(spec.scalers) >= N_COLS
    out = apply_prep(df, spec)
    assert out.count() == df.dropDuplicates().count()


def test_wide_correlations_and_leak(spark):
    df = _wide(spark)
    assert leaked_features(df, "y", threshold=0.99) == ["leak"]
    flags = correlation_flags(df, "y", threshold=0.9).collect()
    assert {(r["col_a"], r["col_b"]) for r in flags} == {("leak", "y")}


def test_undefined_correlation_stays_null(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (2.0, None, 5.0), (3.0, None, 5.0)], "a double, b double, c double")
    rows = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert rows[("a", "b")] is None and rows[("a", "c")] is None


def test_wide_profile_and_variance(spark):
    from tablesmith.operators.profile import column_profile
    from tablesmith.operators.selection import variance_table
    df = _wide(spark)
    prof = column_profile(df).collect()
    assert len(prof) == N_COLS + 3
    assert {r["column_name"]: r["missing_fraction"] for r in prof}["txt"] > 0
    assert variance_table(df, "y").where("kept").count() == N_COLS + 1
