"""The planted faults of the synthetic churn table are found and repaired (the reference's own test strategy)."""

import pytest
from pyspark.sql import functions as F

from tablesmith.operators.leakage import leaked_features
from tablesmith.operators.prep import dedupe_rows
from tablesmith.operators.profile import detect_problem_type, infer_dtypes
from tablesmith.plans.prep_fit import fit_prep, infer_plan
from tablesmith.sources.synth import N_DUPLICATES, synthetic_churn


@pytest.fixture(scope="module")
def synth(spark):
    return synthetic_churn(spark, 2000, seed=42).cache()


def test_shape_and_duplicates(synth):
    assert synth.count() == 2000 + N_DUPLICATES
    assert dedupe_rows(synth).count() == 2000


def test_partitioning_does_not_change_rows(spark, synth):
    again = synthetic_churn(spark, 2000, seed=42).repartition(7)
    assert synth.exceptAll(again).count() == 0


def test_faults_are_found(synth):
    assert detect_problem_type(synth, "churn") == "classification"
    dtypes = {r["column_name"]: r["dtype"] for r in infer_dtypes(synth).collect()}
    assert dtypes["credit_score_text"] == "mixed_numeric"
    assert dtypes["signup_date"] == "datetime_string"
    assert "leaky_churn_copy" in leaked_features(synth, "churn")
    plan = infer_plan(synth, "churn")
    assert "annual_income" in plan.impute and "tenure_months" in plan.impute
    assert "customer_id" in plan.drop_cols and "legacy_flag" in plan.drop_cols
    spec = fit_prep(synth, "churn", plan)
    assert {"all_null_feature", "legacy_flag", "customer_id"} <= set(spec.dropped_columns)
    lo, hi = spec.clip_bounds["monthly_usage_gb"]
    assert synth.where((F.col("monthly_usage_gb") > hi) | (F.col("monthly_usage_gb") < lo)).count() >= 20
