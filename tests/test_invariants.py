"""Invariants of the preparation and evaluation operators."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tablesmith.operators.folds import hash_folds, stratified_folds
from tablesmith.operators.quantiles import quantiles
from tablesmith.operators.rules import validate_metric
from tablesmith.operators.selection import determine_k
from tablesmith.plans.prep_fit import apply_prep, fit_prep, output_names, staged
from tablesmith.plans.spec import PrepPlan, PrepSpec
from tablesmith.sources.fixtures import dirty
from tablesmith.sources.tables import load_table


@pytest.fixture(scope="module")
def fitted(spark):
    d = dirty(spark, SF_SMALL)
    return d, fit_prep(d, "churn")


def test_scaled_columns_have_mean_0_std_1_on_fit_rows(fitted):
    d, spec = fitted
    out = apply_prep(d, spec, "train")
    for c in spec.scalers:
        m, s = out.agg(F.avg(F.col(f"`{c}`")), F.stddev_samp(F.col(f"`{c}`"))).collect()[0]
        assert abs(m) < 1e-9
        assert abs(s - 1.0) < 1e-9 or s < 1.0 + 1e-9  # clipped / constant columns can only shrink


def test_score_mode_keeps_every_row(fitted):
    d, spec = fitted
    assert apply_prep(d, spec, "score").count() == d.count()


def test_apply_distributes_over_union(fitted):
    d, spec = fitted
    a = d.where(F.col("age") < 40)
    b = d.where(F.col("age") >= 40)
    whole = apply_prep(d, spec, "score")
    parts = apply_prep(a, spec, "score").unionByName(apply_prep(b, spec, "score"))
    assert whole.exceptAll(parts).count() == 0 and parts.exceptAll(whole).count() == 0


def test_spec_json_roundtrip(fitted):
    _, spec = fitted
    again = PrepSpec.from_json(spec.to_json())
    assert again == spec


def test_plan_is_not_mutated(spark):
    d = dirty(spark, SF_SMALL)
    plan = PrepPlan(datetime_cols=["signup_date"], mixed_numeric_cols=["credit_score_text"],
                    drop_cols=["customer_id"], encode={"segment": "onehot"})
    before = plan.to_dict()
    fit_prep(d, "churn", plan)
    assert plan.to_dict() == before


def test_constant_fill_needs_value_and_target_cannot_be_dropped(spark):
    d = dirty(spark, SF_SMALL)
    with pytest.raises(ValueError):
        fit_prep(d, "churn", PrepPlan(impute={"annual_income": "constant"}))
    with pytest.raises(ValueError):
        fit_prep(d, "churn", PrepPlan(drop_cols=["churn"]))


def test_constant_fill_and_ordinal_and_target_encoding(spark):
    d = dirty(spark, SF_SMALL)
    plan = PrepPlan(drop_cols=["customer_id", "signup_date", "credit_score_text"],
                    impute={"annual_income": "constant", "segment": "mode"}, fill_values={"annual_income": 0.0},
                    encode={"segment": "ordinal", "region": "target"}, iqr_k=None, scale_strategy="none")
    spec = fit_prep(d, "churn", plan)
    assert spec.fills["annual_income"] == 0.0
    assert spec.ordinal["segment"] == ["basic", "premium", "standard"]
    out = apply_prep(d, spec, "score")
    assert out.where(F.col("annual_income").isNull()).count() == 0
    assert set(r[0] for r in out.select("segment").distinct().collect()) <= {0.0, 1.0, 2.0}


def test_clip_encoded_parity_switch(spark):
    d = dirty(spark, SF_SMALL)
    default = fit_prep(d, "churn")
    parity = fit_prep(d, "churn", PrepPlan(**{**default.plan, "clip_encoded": True}))
    assert "segment_premium" not in default.clip_bounds
    assert parity.clip_bounds["segment_premium"] == [0.0, 0.0]  # rare dummy clipped to constant (parity)


def test_stratified_folds_are_balanced(spark):
    e = load_table(spark, SF_SMALL, "events")
    f = stratified_folds(e, "event_id", "event_type", k=3, buckets=4)
    counts = f.groupBy("event_type", "fold").count().groupBy("event_type").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in counts)
    assert f.count() == e.count()


def test_hash_folds_cover_all_rows(spark):
    e = load_table(spark, SF_SMALL, "events")
    assert hash_folds(e, "event_id", 3).where(F.col("fold").between(0, 2)).count() == e.count()


def test_bracket_quantiles_equal_exact(spark):
    li = load_table(spark, SF_SMALL, "lineitem")
    exprs = {c: F.col(c) for c in ["l_quantity", "l_extendedprice", "l_discount"]}
    probs = [0.1, 0.25, 0.5, 0.75, 0.99]
    a = li.agg(*[F.percentile(e, F.array(*map(F.lit, probs))).alias(c) for c, e in exprs.items()]).first()
    b = quantiles(li, exprs, probs, accuracy=100)
    for c in exprs:
        assert a[c] == pytest.approx(b[c], rel=1e-12)


def test_determine_k_and_metric_family():
    assert determine_k(10, 1.0) == 1          # an absolute count of one (kept for parity)
    assert determine_k(10, 0.25) == 2         # half-even rounding of 2.5
    assert determine_k(10, 0.5) == 5
    assert determine_k(10, 0) == 10
    with pytest.raises(ValueError):
        validate_metric("r2", "classification")


def test_expressions_are_shared_between_fit_and_apply(fitted):
    d, spec = fitted
    types = {f.name: f.dataType for f in d.schema.fields}
    out, _ = staged(d, spec, "scale")
    assert out.columns == spec.output_columns == output_names(spec, types)


def test_bracket_narrowing_with_a_hot_value(spark, monkeypatch):
    import tablesmith.operators.quantiles as Q
    monkeypatch.setattr(Q, "BRACKET_ROWS", 50)   # force several narrowing rounds on a small table
    li = load_table(spark, SF_SMALL, "lineitem").withColumn(
        "hot", F.when(F.col("l_orderkey") % 3 == 0, F.lit(7.0)).otherwise(F.col("l_extendedprice")))
    exprs = {"hot": F.col("hot"), "l_partkey": F.col("l_partkey")}
    probs = [0.0, 0.2, 0.5, 0.77, 1.0]
    a = li.agg(*[F.percentile(e, F.array(*map(F.lit, probs))).alias(c) for c, e in exprs.items()]).first()
    b = quantiles(li, exprs, probs, accuracy=50)
    for c in exprs:
        assert a[c] == pytest.approx(b[c], rel=1e-12)


def test_dedupe_switch_positions(spark):
    d = dirty(spark, SF_SMALL)
    after = fit_prep(d, "churn")
    before = fit_prep(d, "churn", PrepPlan(**{**after.plan, "dedupe": "before_drop"}))
    n_after = apply_prep(d, after, "train").count()
    n_before = apply_prep(d, before, "train").count()
    assert after.dedupe == "after_drop" and before.dedupe == "before_drop"
    assert n_before >= n_after  # dropping the id first can only merge more rows


def test_impute_all_switch(spark):
    d = dirty(spark, SF_SMALL)
    base = fit_prep(d, "churn")
    every = fit_prep(d, "churn", PrepPlan(**{**base.plan, "impute_all": True}))
    assert "age" not in base.fills            # no nulls at fit time -> no fill (parity)
    assert "age" in every.fills               # option: every numeric feature gets one
    scored = apply_prep(d.withColumn("age", F.lit(None).cast("int")), every, "score")
    assert scored.where(F.col("age").isNull()).count() == 0


def test_run_many_reports_a_failing_table(spark):
    from tablesmith.plans.run import battery_summary, run_many
    li = load_table(spark, SF_SMALL, "lineitem").select("l_quantity", "l_extendedprice")
    out = run_many(spark, {"bad": (li, "no_such_column")}, tune=False).collect()
    assert out[0]["status"].startswith("Failed")
    flag = battery_summary(spark.createDataFrame([(r["dataset"], r["status"]) for r in out],
                                                 "dataset string, status string")).collect()[0]
    assert flag["all_passed"] is False


def test_approx_quantiles_are_close(spark):
    li = load_table(spark, SF_SMALL, "lineitem")
    exact = quantiles(li, {"p": F.col("l_extendedprice")}, [0.1, 0.5, 0.9], "exact")["p"]
    approx = quantiles(li, {"p": F.col("l_extendedprice")}, [0.1, 0.5, 0.9], "approx")["p"]
    ranks = li.select(*[F.count_if(F.col("l_extendedprice") <= F.lit(a)).alias(f"r{i}")
                        for i, a in enumerate(approx)]).collect()[0]
    n = li.count()
    for i, p in enumerate([0.1, 0.5, 0.9]):
        assert abs(ranks[f"r{i}"] / n - p) < 0.01    # rank error of the sketch
    assert approx[1] == pytest.approx(exact[1], rel=0.05)
