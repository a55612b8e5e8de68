"""Preparation checks (P1–P6, D1–D5, A10–A15, E1–E13, PIPE-0..3) on ``dirty`` and driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablesmith.functions.exprs import qcol, rnd, to_num
from tablesmith.functions.text import feature_badges, redact_paths, score_cell
from tablesmith.operators import prep as ops
from tablesmith.operators.association import target_copies, text_associations
from tablesmith.operators.labels import label_encode
from tablesmith.operators.rules import default_target
from tablesmith.operators.sampling import sample_n
from tablesmith.plans.fold_scope import encode_out_of_fold, fit_prep_by_fold
from tablesmith.plans.prep_fit import apply_prep, fit_prep, infer_plan, plan_table, prep_dataframe, spec_table
from tablesmith.plans.spec import PrepPlan
from tablesmith.registry import duck_num, duck_ts, register, union_all, with_fixtures
from tablesmith.session import scratch_path
from tablesmith.sources.catalog import merge_versioned, read_version
from tablesmith.sources.fixtures import DIRTY_COLUMNS, DIRTY_TARGET, dirty
from tablesmith.sources.tables import load_table

Q = '"'


def _dq(name: str) -> str:
    return Q + name + Q


# ---------------------------------------------------------------------------------------------------------------
# Projections / filters / dedupe / union / sample
# ---------------------------------------------------------------------------------------------------------------

_ALL = ", ".join(DIRTY_COLUMNS)


@register("drop_columns", with_fixtures(
    "SELECT " + ", ".join(c for c in DIRTY_COLUMNS if c not in ("customer_id", "legacy_flag")) + " FROM dirty",
    "dirty"))
def q_drop_columns(spark, sf_dir):
    return ops.drop_columns(dirty(spark, sf_dir), ["customer_id", "legacy_flag", "no_such_column"])


@register("drop_all_null", with_fixtures(
    "SELECT " + ", ".join(c for c in DIRTY_COLUMNS if c != "all_null_feature") + " FROM dirty", "dirty"))
def q_drop_all_null(spark, sf_dir):
    return ops.drop_all_null_columns(dirty(spark, sf_dir))


@register("drop_constant", with_fixtures(
    "SELECT " + ", ".join(c for c in DIRTY_COLUMNS if c not in ("all_null_feature", "legacy_flag")) + " FROM dirty",
    "dirty"))
def q_drop_constant(spark, sf_dir):
    return ops.drop_constant_columns(dirty(spark, sf_dir))


@register("drop_null_target", with_fixtures(f"SELECT {_ALL} FROM dirty WHERE churn IS NOT NULL", "dirty"))
def q_drop_null_target(spark, sf_dir):
    return ops.drop_null_target(dirty(spark, sf_dir), DIRTY_TARGET)


_FEATURES = ["age", "annual_income", "tenure_months", "segment"]


@register("project_features", with_fixtures(f"SELECT {', '.join(_FEATURES)}, churn FROM dirty", "dirty"))
def q_project_features(spark, sf_dir):
    return dirty(spark, sf_dir).select(*_FEATURES, DIRTY_TARGET)


@register("numeric_only", with_fixtures(
    "SELECT age, annual_income, tenure_months, monthly_usage_gb, leaky_churn_copy, all_null_feature FROM dirty",
    "dirty"))
def q_numeric_only(spark, sf_dir):
    from tablesmith.operators.selection import numeric_features
    d = dirty(spark, sf_dir)
    return d.select(*numeric_features(d, DIRTY_TARGET))


@register("dedupe_rows", with_fixtures(f"SELECT DISTINCT {_ALL} FROM dirty", "dirty"))
def q_dedupe_rows(spark, sf_dir):
    return ops.dedupe_rows(dirty(spark, sf_dir))


_SAMPLE_SQL = ("SELECT {cols} FROM dirty ORDER BY ('0x' || substr(md5(customer_id || ':42'), 1, 8))::BIGINT, "
               "customer_id, annual_income NULLS FIRST LIMIT 20")


@register("sample_n", with_fixtures(
    "SELECT * FROM (" + _SAMPLE_SQL.format(cols=_ALL) + ")", "dirty"))
def q_sample_n(spark, sf_dir):
    return sample_n(dirty(spark, sf_dir), 20, key=["customer_id", "annual_income"], seed=42)


@register("union_all", with_fixtures(
    f"SELECT {_ALL} FROM dirty UNION ALL SELECT * FROM (" + _SAMPLE_SQL.format(cols=_ALL) + ")", "dirty"))
def q_union_all(spark, sf_dir):
    d = dirty(spark, sf_dir)
    return d.unionByName(sample_n(d, 20, key=["customer_id", "annual_income"], seed=42))


# ---------------------------------------------------------------------------------------------------------------
# Coercion, datetime, label encoding
# ---------------------------------------------------------------------------------------------------------------


@register("coerce_mixed", with_fixtures(
    f"SELECT customer_id, {duck_num('credit_score_text', 'str')} AS credit_score_text FROM dirty", "dirty"))
def q_coerce_mixed(spark, sf_dir):
    return ops.coerce_numeric(dirty(spark, sf_dir).select("customer_id", "credit_score_text"), ["credit_score_text"])


@register("coerce_numeric_string",
          f"SELECT c_custkey, {duck_num('CAST(c_acctbal AS VARCHAR)', 'str')} AS c_acctbal FROM customer")
def q_coerce_numeric_string(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    if ops.count_coercion_failures(c, "c_acctbal"):
        raise AssertionError("numeric text column has unparseable values")
    return ops.coerce_numeric(c, ["c_acctbal"])


@register("parse_datetime", with_fixtures(
    f"SELECT customer_id, CAST({duck_ts('signup_date')} AS VARCHAR) AS signup_date FROM dirty", "dirty"))
def q_parse_datetime(spark, sf_dir):
    d = ops.parse_datetime(dirty(spark, sf_dir).select("customer_id", "signup_date"), "signup_date")
    return d.select("customer_id", F.col("signup_date").cast("string").alias("signup_date"))


@register("datetime_features", """
SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year, CAST(month(o_orderdate) AS DOUBLE) AS
  o_orderdate_month, CAST(day(o_orderdate) AS DOUBLE) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dayofweek FROM orders""")
def q_datetime_features(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ops.add_datetime_features(o, "o_orderdate")


@register("label_encode", """
SELECT e.event_id, l.code AS label FROM events e JOIN (
  SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT event_type FROM events)) l USING (event_type)""")
def q_label_encode(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_id", "event_type")
    enc, _labels = label_encode(e, "event_type", "label")
    return enc.select("event_id", "label")


@register("label_encode_many", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS label FROM customer""")
def q_label_encode_many(spark, sf_dir):
    """E13 over a column with as many labels as rows: codes come from a stored table."""
    enc, _ = label_encode(load_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "label")
    return enc.select("c_custkey", "label")


@register("ordinal_many", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_custkey) - 1 AS DOUBLE) AS o_custkey FROM orders""")
def q_ordinal_many(spark, sf_dir):
    """E2/E4 over thousands of categories."""
    o = load_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ops.transform_encoders(o, ops.fit_encoders(o, ["o_custkey"], "ordinal"))


@register("onehot_many", """
SELECT c_custkey, 'c_nationkey_' || CAST(CAST(c_nationkey AS DOUBLE) AS VARCHAR) AS hot FROM customer""")
def q_onehot_many(spark, sf_dir):
    """E1 without a cap: one output column per nation, read back as the name of the column that is set."""
    c = load_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    wide = ops.transform_encoders(c, ops.fit_encoders(c, ["c_nationkey"], "onehot"))
    names = [n for n in wide.columns if n != "c_custkey"]
    return wide.select("c_custkey", F.array_join(F.array_compact(F.array(*[F.when(qcol(n) == 1, F.lit(n)) for n in names])), ",").alias("hot"))


@register("dedupe_before_drop", """
SELECT l_suppkey AS y, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM lineitem)
GROUP BY l_suppkey""")
def q_dedupe_before_drop(spark, sf_dir):
    """Rows are compared before columns are dropped, at fit and at apply."""
    li = load_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("y"), "l_orderkey", "l_linenumber", "l_quantity")
    plan = PrepPlan(drop_cols=["l_orderkey", "l_linenumber"], dedupe="before_drop")
    out, _ = prep_dataframe(li, "y", plan)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@register("plan_override", """
SELECT 'segment' AS column_name, 'ordinal' AS action UNION ALL SELECT 'region', 'onehot' UNION ALL
SELECT 'customer_id', 'drop' UNION ALL SELECT 'signup_date', 'datetime' UNION ALL SELECT 'credit_score_text', 'coerce'
UNION ALL SELECT 'age', 'drop' UNION ALL SELECT 'annual_income', 'keep' UNION ALL SELECT 'tenure_months', 'keep' UNION ALL
SELECT 'monthly_usage_gb', 'keep' UNION ALL SELECT 'leaky_churn_copy', 'keep' UNION ALL SELECT 'churn', 'target' UNION ALL
SELECT 'all_null_feature', 'keep' UNION ALL SELECT 'legacy_flag', 'drop'""")
def q_plan_override(spark, sf_dir):
    """R2: a given plan for two columns, the inferred one for the others."""
    d = dirty(spark, sf_dir)
    spec = fit_prep(d, DIRTY_TARGET, PrepPlan(drop_cols=["age"], encode={"segment": "ordinal"}), infer_rest=True)
    return plan_table(PrepPlan.from_dict(spec.plan), d.columns, DIRTY_TARGET, spark).select("column_name", "action")


# ---------------------------------------------------------------------------------------------------------------
# Fills
# ---------------------------------------------------------------------------------------------------------------

_NUM_FILL_COLS = ["annual_income", "tenure_months", "monthly_usage_gb"]


def _fill_query(strategy: str):
    def q(spark, sf_dir):
        d = dirty(spark, sf_dir)
        exprs = {c: qcol(c) for c in _NUM_FILL_COLS}
        exprs["credit_score_text"] = to_num(qcol("credit_score_text"), d.schema["credit_score_text"].dataType)
        fills = ops.fit_fills(d, exprs, {c: strategy for c in exprs}, {c: True for c in exprs})
        rows = [(c, None if v is None else float(v)) for c, v in fills.items()]
        return spark.createDataFrame(rows, "column_name string, fill double").select(
            "column_name", rnd(F.col("fill")).alias("fill"))
    return q


def _fill_oracle(agg: str) -> str:
    cols = [(c, c) for c in _NUM_FILL_COLS] + [("credit_score_text", duck_num("credit_score_text", "str"))]
    return with_fixtures(union_all([f"SELECT '{n}' AS column_name, round({agg.format(x=e)}, 6) AS fill FROM dirty"
                                    for n, e in cols]), "dirty")


register("impute_mean", _fill_oracle("avg({x})"))(_fill_query("mean"))
register("impute_median", _fill_oracle("quantile_cont({x}, 0.5)"))(_fill_query("median"))


@register("impute_mode", with_fixtures(union_all([
    f"SELECT '{c}' AS column_name, v AS fill FROM (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER "
    f"(ORDER BY count(*) DESC, {c}) AS r FROM dirty WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r = 1"
    for c in ["segment", "region", "credit_score_text"]] + [
    "SELECT 'tenure_months' AS column_name, CAST(v AS VARCHAR) FROM (SELECT tenure_months AS v, row_number() OVER "
    "(ORDER BY count(*) DESC, tenure_months) AS r FROM dirty WHERE tenure_months IS NOT NULL GROUP BY tenure_months) "
    "WHERE r = 1"]), "dirty"))
def q_impute_mode(spark, sf_dir):
    d = dirty(spark, sf_dir)
    cols = ["segment", "region", "credit_score_text", "tenure_months"]
    fills = ops.fit_fills(d, {c: qcol(c) for c in cols}, {c: "mode" for c in cols},
                          {c: c == "tenure_months" for c in cols})
    rows = [(c, str(v)) for c, v in fills.items()]
    return spark.createDataFrame(rows, "column_name string, fill string")


@register("impute_constant", with_fixtures(
    "SELECT customer_id, coalesce(annual_income, 0.0e0) AS annual_income, "
    "coalesce(credit_score_text, 'missing') AS credit_score_text FROM dirty", "dirty"))
def q_impute_constant(spark, sf_dir):
    d = dirty(spark, sf_dir).select("customer_id", "annual_income", "credit_score_text")
    d, _ = ops.impute_column(d, "annual_income", "constant", fill_value=0.0)
    d, _ = ops.impute_column(d, "credit_score_text", "constant", fill_value="missing")
    return d


@register("apply_fill", with_fixtures(
    "SELECT customer_id, round(coalesce(tenure_months, (SELECT quantile_cont(tenure_months, 0.5) FROM dirty)), 6) "
    "AS tenure_months FROM dirty", "dirty"))
def q_apply_fill(spark, sf_dir):
    d = dirty(spark, sf_dir).select("customer_id", "tenure_months")
    d, _ = ops.impute_column(d, "tenure_months", "median")
    return d.select("customer_id", rnd(F.col("tenure_months")).alias("tenure_months"))


# ---------------------------------------------------------------------------------------------------------------
# Encoders
# ---------------------------------------------------------------------------------------------------------------

_SEGMENTS = ["basic", "premium", "standard"]


@register("onehot", with_fixtures(
    "SELECT customer_id, " + ", ".join(
        f"CAST(CASE WHEN segment IS NOT DISTINCT FROM '{s}' THEN 1 ELSE 0 END AS TINYINT) AS segment_{s}"
        for s in _SEGMENTS) + " FROM dirty", "dirty"))
def q_onehot(spark, sf_dir):
    d = dirty(spark, sf_dir).select("customer_id", "segment")
    return ops.transform_encoders(d, ops.fit_encoders(d, ["segment"], "onehot"))


@register("ordinal", with_fixtures("""
SELECT customer_id, coalesce(CAST(code AS DOUBLE), -1.0e0) AS region FROM dirty LEFT JOIN (
  SELECT r, row_number() OVER (ORDER BY r) - 1 AS code FROM (SELECT DISTINCT region AS r FROM dirty
  WHERE region IS NOT NULL)) ON region = r""", "dirty"))
def q_ordinal(spark, sf_dir):
    d = dirty(spark, sf_dir).select("customer_id", "region")
    return ops.transform_encoders(d, ops.fit_encoders(d, ["region"], "ordinal"))


@register("target_encode_fit", with_fixtures(
    "SELECT region AS category, round(avg(CAST(churn AS DOUBLE)), 6) AS mean FROM dirty WHERE region IS NOT NULL "
    "GROUP BY region UNION ALL SELECT '__global__', round(avg(CAST(churn AS DOUBLE)), 6) FROM dirty", "dirty"))
def q_target_encode_fit(spark, sf_dir):
    d = dirty(spark, sf_dir)
    st = ops.fit_encoders(d, ["region"], "target", target_col=DIRTY_TARGET)["region"]
    rows = list(zip(st["values"], st["means"])) + [("__global__", st["global_mean"])]
    return spark.createDataFrame(rows, "category string, mean double").select(
        "category", rnd(F.col("mean")).alias("mean"))


@register("target_encode", with_fixtures("""
SELECT customer_id, round(coalesce(m, (SELECT avg(CAST(churn AS DOUBLE)) FROM dirty)), 6) AS segment FROM dirty
LEFT JOIN (SELECT segment AS s, avg(CAST(churn AS DOUBLE)) AS m FROM dirty GROUP BY segment) ON segment = s""",
    "dirty"))
def q_target_encode(spark, sf_dir):
    d = dirty(spark, sf_dir).select("customer_id", "segment", DIRTY_TARGET)
    enc = ops.transform_encoders(d, ops.fit_encoders(d, ["segment"], "target", target_col=DIRTY_TARGET))
    return enc.select("customer_id", rnd(F.col("segment")).alias("segment"))


# ---------------------------------------------------------------------------------------------------------------
# Scaling and clipping statistics
# ---------------------------------------------------------------------------------------------------------------

_SCALE_COLS = ["age", "annual_income", "tenure_months", "monthly_usage_gb", "all_null_feature"]


def _scale_query(strategy: str):
    def q(spark, sf_dir):
        d = dirty(spark, sf_dir)
        p = ops.fit_scalers(d, {c: qcol(c) for c in _SCALE_COLS}, strategy)
        rows = [(c, v[1], v[2]) for c, v in p.items()]
        return spark.createDataFrame(rows, "column_name string, center double, scale double").select(
            "column_name", rnd(F.col("center")).alias("center"), rnd(F.col("scale")).alias("scale"))
    return q


def _scale_oracle(center: str, scale: str) -> str:
    return with_fixtures(union_all([
        f"SELECT '{c}' AS column_name, round({center.format(x=c)}, 6) AS center, "
        f"round(coalesce(nullif({scale.format(x=c)}, 0), 1.0e0), 6) AS scale FROM dirty HAVING count({c}) > 0"
        for c in _SCALE_COLS]), "dirty")


register("scale_fit_standard", _scale_oracle("avg(CAST({x} AS DOUBLE))", "stddev_samp(CAST({x} AS DOUBLE))"))(
    _scale_query("standard"))
register("scale_fit_minmax", _scale_oracle("min(CAST({x} AS DOUBLE))", "max({x}) - min({x})"))(
    _scale_query("minmax"))
register("scale_fit_robust", _scale_oracle(
    "quantile_cont({x}, 0.5)", "quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)"))(_scale_query("robust"))

_CLIP_COLS = ["age", "annual_income", "monthly_usage_gb"]


@register("clip_iqr", with_fixtures(union_all([
    f"SELECT '{c}' AS column_name, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper "
    f"FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty)"
    for c in _CLIP_COLS]), "dirty"))
def q_clip_iqr(spark, sf_dir):
    d = dirty(spark, sf_dir)
    b = ops.fit_clip_iqr(d, {c: qcol(c) for c in _CLIP_COLS}, 1.5)
    return spark.createDataFrame([(c, v[0], v[1]) for c, v in b.items()],
                                 "column_name string, lower double, upper double").select(
        "column_name", rnd(F.col("lower")).alias("lower"), rnd(F.col("upper")).alias("upper"))


@register("clip_percentile", with_fixtures(union_all([
    f"SELECT '{c}' AS column_name, round(quantile_cont({c}, 0.01), 6) AS lower, "
    f"round(quantile_cont({c}, 0.99), 6) AS upper FROM dirty" for c in _CLIP_COLS]), "dirty"))
def q_clip_percentile(spark, sf_dir):
    d = dirty(spark, sf_dir)
    b = ops.fit_clip_percentile(d, {c: qcol(c) for c in _CLIP_COLS}, 0.01, 0.99)
    return spark.createDataFrame([(c, v[0], v[1]) for c, v in b.items()],
                                 "column_name string, lower double, upper double").select(
        "column_name", rnd(F.col("lower")).alias("lower"), rnd(F.col("upper")).alias("upper"))


@register("apply_clip", with_fixtures("""
WITH b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(monthly_usage_gb, 0.25) AS q1, quantile_cont(monthly_usage_gb, 0.75) AS q3 FROM dirty))
SELECT customer_id, round(CASE WHEN monthly_usage_gb < lo THEN lo WHEN monthly_usage_gb > hi THEN hi
  ELSE monthly_usage_gb END, 6) AS monthly_usage_gb FROM dirty, b""", "dirty"))
def q_apply_clip(spark, sf_dir):
    d = dirty(spark, sf_dir).select("customer_id", "monthly_usage_gb")
    d, _ = ops.clip_outliers_iqr(d, "monthly_usage_gb", k=1.5)
    return d.select("customer_id", rnd(F.col("monthly_usage_gb")).alias("monthly_usage_gb"))


@register("apply_scale", with_fixtures("""
WITH s AS (SELECT avg(annual_income) AS m, stddev_samp(annual_income) AS sd FROM dirty)
SELECT customer_id, round((annual_income - m) / sd, 6) AS annual_income FROM dirty, s""", "dirty"))
def q_apply_scale(spark, sf_dir):
    d = dirty(spark, sf_dir).select("customer_id", "annual_income")
    p = ops.fit_scalers(d, {"annual_income": qcol("annual_income")}, "standard")
    out = ops.transform_scalers(d, p)
    return out.select("customer_id", rnd(F.col("annual_income")).alias("annual_income"))


# ---------------------------------------------------------------------------------------------------------------
# Composite: plan, fit statistics, transform
# ---------------------------------------------------------------------------------------------------------------

_PLAN_ROWS = [("customer_id", "drop", None), ("age", "keep", None), ("annual_income", "keep", "median"),
              ("tenure_months", "keep", "median"), ("monthly_usage_gb", "keep", None),
              ("segment", "onehot", None), ("region", "onehot", None),
              ("credit_score_text", "coerce", "median"), ("signup_date", "datetime", None),
              ("leaky_churn_copy", "keep", None), ("churn", "target", None), ("all_null_feature", "keep", "median"),
              ("legacy_flag", "drop", None)]


def _duck_plan() -> str:
    """Plan rules written out in SQL over the same facts (null counts, number/date shares, distinct counts)."""
    sel = []
    for c in DIRTY_COLUMNS:
        if c == "churn":
            sel.append("SELECT 'churn' AS column_name, 'target' AS action, CAST(NULL AS VARCHAR) AS detail")
            continue
        miss = f"count(*) FILTER (WHERE churn IS NOT NULL AND {c} IS NULL) > 0"
        if c in ("age", "annual_income", "tenure_months", "monthly_usage_gb", "leaky_churn_copy", "all_null_feature"):
            sel.append(f"SELECT '{c}' AS column_name, 'keep' AS action, CASE WHEN {miss} THEN 'median' END AS detail "
                       f"FROM dirty")
            continue
        nn = f"count({c}) FILTER (WHERE churn IS NOT NULL)"
        num = f"count({duck_num(c, 'str')}) FILTER (WHERE churn IS NOT NULL)"
        dtc = f"count({duck_ts(c)}) FILTER (WHERE churn IS NOT NULL)"
        ndv = f"count(DISTINCT {c}) FILTER (WHERE churn IS NOT NULL)"
        action = (f"CASE WHEN {nn} = 0 THEN 'drop' WHEN {num} > 0 THEN 'coerce' WHEN {dtc} / {nn} >= 0.9 THEN "
                  f"'datetime' WHEN {ndv} <= 1 OR {ndv} > 50 THEN 'drop' ELSE 'onehot' END")
        detail = (f"CASE WHEN {nn} = 0 THEN NULL WHEN {num} > 0 THEN CASE WHEN {miss} OR {num} < {nn} THEN 'median' "
                  f"END WHEN {dtc} / {nn} >= 0.9 THEN NULL WHEN {ndv} <= 1 OR {ndv} > 50 THEN NULL "
                  f"WHEN {miss} THEN 'mode' END")
        sel.append(f"SELECT '{c}' AS column_name, {action} AS action, {detail} AS detail FROM dirty")
    return union_all(sel)


@register("infer_plan", with_fixtures(_duck_plan(), "dirty"))
def q_infer_plan(spark, sf_dir):
    d = dirty(spark, sf_dir)
    plan = infer_plan(d, DIRTY_TARGET)
    return plan_table(plan, d.columns, DIRTY_TARGET, spark)


# The oracle of the fitted preparation, written out step by step in SQL.
_KEPT = ["age", "annual_income", "tenure_months", "monthly_usage_gb", "segment", "region", "credit_score_text",
         "signup_date", "leaky_churn_copy", "churn"]
_REGIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_DT = ["signup_date_year", "signup_date_month", "signup_date_day", "signup_date_dayofweek"]
_FILLED = ["annual_income", "tenure_months", "credit_score_text"] + _DT
_CLIPPED = ["age", "annual_income", "tenure_months", "monthly_usage_gb", "credit_score_text", "leaky_churn_copy"] + _DT
_ONEHOT = [f"segment_{s}" for s in _SEGMENTS] + [f"region_{r}" for r in _REGIONS]
_SCALED = _CLIPPED + _ONEHOT


def _duck_prep_ctes() -> str:
    coerce = (f"SELECT CAST(age AS DOUBLE) AS age, annual_income, tenure_months, monthly_usage_gb, segment, region, "
              f"{duck_num('credit_score_text', 'str')} AS credit_score_text, leaky_churn_copy, churn, "
              f"CAST(year(ts) AS DOUBLE) AS signup_date_year, CAST(month(ts) AS DOUBLE) AS signup_date_month, "
              f"CAST(day(ts) AS DOUBLE) AS signup_date_day, CAST(isodow(ts) - 1 AS DOUBLE) AS signup_date_dayofweek "
              f"FROM (SELECT *, {duck_ts('signup_date')} AS ts FROM b)")
    fills = "SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS f_{c}" for c in _FILLED) + " FROM c"
    filled = ("SELECT age, monthly_usage_gb, leaky_churn_copy, churn, segment, region, " +
              ", ".join(f"coalesce({c}, f_{c}) AS {c}" for c in _FILLED) + " FROM c, fills")
    enc = ("SELECT *, " + ", ".join(
        [f"CASE WHEN segment IS NOT DISTINCT FROM '{s}' THEN 1.0e0 ELSE 0.0e0 END AS segment_{s}" for s in _SEGMENTS] +
        [f"CASE WHEN region IS NOT DISTINCT FROM '{r}' THEN 1.0e0 ELSE 0.0e0 END AS {_dq('region_' + r)}"
         for r in _REGIONS]) + " FROM filled")
    bounds = "SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
        f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
        for c in _CLIPPED) + " FROM enc"
    clipped = ("SELECT churn, " + ", ".join(
        f"CASE WHEN {c} < lo_{c} THEN lo_{c} WHEN {c} > hi_{c} THEN hi_{c} ELSE {c} END AS {c}" for c in _CLIPPED) +
        ", " + ", ".join(_dq(c) for c in _ONEHOT) + " FROM enc, bounds")
    moments = "SELECT " + ", ".join(
        f"avg({_dq(c)}) AS {_dq('m_' + c)}, coalesce(nullif(stddev_samp({_dq(c)}), 0), 1.0e0) AS {_dq('s_' + c)}"
        for c in _SCALED) + " FROM clipped"
    return (f"WITH f AS (SELECT * FROM dirty WHERE churn IS NOT NULL),\n"
            f"b AS (SELECT DISTINCT {', '.join(_KEPT)} FROM f),\nc AS ({coerce}),\nfills AS ({fills}),\n"
            f"filled AS ({filled}),\nenc AS ({enc}),\nbounds AS ({bounds}),\nclipped AS ({clipped}),\n"
            f"moments AS ({moments})\n")


_PREP_TRANSFORM = _duck_prep_ctes() + "SELECT churn, " + ", ".join(
    f"round(({_dq(c)} - {_dq('m_' + c)}) / {_dq('s_' + c)}, 6) AS {_dq(c)}" for c in _SCALED) + \
    " FROM clipped, moments"

_PREP_STATS = _duck_prep_ctes() + union_all(
    [f"SELECT '{c}' AS column_name, 'fill' AS stat, round(f_{c}, 6) AS value FROM fills" for c in _FILLED] +
    [f"SELECT '{c}', 'clip_lower', round(lo_{c}, 6) FROM bounds" for c in _CLIPPED] +
    [f"SELECT '{c}', 'clip_upper', round(hi_{c}, 6) FROM bounds" for c in _CLIPPED] +
    [f"SELECT '{c}', 'center', round({_dq('m_' + c)}, 6) FROM moments" for c in _SCALED] +
    [f"SELECT '{c}', 'scale', round({_dq('s_' + c)}, 6) FROM moments" for c in _SCALED] +
    ["SELECT 'segment', 'n_categories', 3.0e0", "SELECT 'region', 'n_categories', 5.0e0"])


def _rounded(df):
    return df.select(*[rnd(qcol(c)).alias(c) if c != DIRTY_TARGET else qcol(c) for c in df.columns])


@register("prep_fit_stats", with_fixtures(_PREP_STATS, "dirty"))
def q_prep_fit_stats(spark, sf_dir):
    spec = fit_prep(dirty(spark, sf_dir), DIRTY_TARGET)
    t = spec_table(spec, spark)
    return t.select("column_name", "stat", rnd(F.col("value")).alias("value"))


@register("prep_transform", with_fixtures(_PREP_TRANSFORM, "dirty"))
def q_prep_transform(spark, sf_dir):
    d = dirty(spark, sf_dir)
    spec = fit_prep(d, DIRTY_TARGET)
    return _rounded(apply_prep(d, spec, "train"))


@register("prep_dataframe", with_fixtures(_PREP_TRANSFORM, "dirty"))
def q_prep_dataframe(spark, sf_dir):
    out, _spec = prep_dataframe(dirty(spark, sf_dir), DIRTY_TARGET)
    return _rounded(out)



# ---------------------------------------------------------------------------------------------------------------
# Preparation inside cross-validation (K15), copies of the target, keyed merge
# ---------------------------------------------------------------------------------------------------------------

@register("target_mean_out_of_fold", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS fold, l_linestatus, l_returnflag, l_quantity FROM lineitem)
SELECT l_orderkey, l_linenumber,
  round((sum(l_quantity) OVER m - sum(l_quantity) OVER mf) / (count(*) OVER m - count(*) OVER mf), 6) AS l_linestatus,
  round((sum(l_quantity) OVER r - sum(l_quantity) OVER rf) / (count(*) OVER r - count(*) OVER rf), 6) AS l_returnflag
FROM d WINDOW m AS (PARTITION BY l_linestatus), mf AS (PARTITION BY l_linestatus, fold), r AS (PARTITION BY l_returnflag), rf AS (PARTITION BY l_returnflag, fold)""")
def q_target_mean_out_of_fold(spark, sf_dir):
    """K15 with E3: each row's category as the mean target of the rows of the other folds."""
    li = load_table(spark, sf_dir, "lineitem").withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))
    out = encode_out_of_fold(li, ["l_linestatus", "l_returnflag"], "l_quantity", "fold")
    return out.select("l_orderkey", "l_linenumber", rnd(F.col("l_linestatus")).alias("l_linestatus"), rnd(F.col("l_returnflag")).alias("l_returnflag"))


def _fold_stats_sql() -> str:
    """The statistics of a preparation, once for each fold (``age % 3``) without the fold's rows."""
    parts = []
    for f in range(3):
        ctes = _duck_prep_ctes().replace(" FROM f),\nc AS", f" FROM f WHERE age % 3 <> {f}),\nc AS")
        parts.append(f"SELECT {f} AS fold, * FROM ({ctes}{_PREP_STATS[len(_duck_prep_ctes()):]})")
    return union_all(parts)


@register("prep_by_fold", with_fixtures("WITH every AS (" + _fold_stats_sql() + ") SELECT * FROM every", "dirty"))
def q_prep_by_fold(spark, sf_dir):
    """The statistics of each fold's preparation, all from the same passes."""
    specs, _, _ = fit_prep_by_fold(dirty(spark, sf_dir), DIRTY_TARGET, F.col("age") % 3)
    out = None
    for f, spec in specs.items():
        part = spec_table(spec, spark).select(F.lit(f).alias("fold"), "column_name", "stat", rnd(F.col("value")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


_ASSOCIATED = ["segment", "region", "signup_date", "customer_id", "verdict"]
_ASSOCIATION_SQL = """WITH d AS (SELECT *, CASE WHEN churn = 1 THEN 'gone' WHEN churn = 0 THEN 'stays' END AS verdict FROM dirty WHERE churn IS NOT NULL),
x AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS k, {c} AS v, churn AS y FROM d WHERE {c} IS NOT NULL" for c in _ASSOCIATED) + """),
c AS (SELECT k, v, y, count(*) AS n FROM x GROUP BY k, v, y),
r AS (SELECT k, v, sum(n) AS nv, count(*) AS classes FROM c GROUP BY k, v),
m AS (SELECT k, y, sum(n) AS ny FROM c GROUP BY k, y),
p AS (SELECT k, sum(CAST(n AS DOUBLE) * n / (nv * ny)) AS phi FROM c JOIN r USING (k, v) JOIN m USING (k, y) GROUP BY k)
SELECT k AS column_name, CAST(sum(nv) AS BIGINT) AS n_rows, count(*) AS n_values, round(sum(CASE WHEN nv > 1 THEN nv ELSE 0 END) / sum(nv), 6) AS repeat_share,
  bool_and(nv = 1 OR classes = 1) AS determined, round(sqrt(greatest(any_value(phi) - 1, 0) / (least(count(*), 2) - 1)), 6) AS cramers_v
FROM r JOIN p USING (k) GROUP BY k"""


def _with_verdict(spark, sf_dir):
    return dirty(spark, sf_dir).withColumn("verdict", F.when(F.col("churn") == 1, "gone").when(F.col("churn") == 0, "stays"))


@register("text_association", with_fixtures(_ASSOCIATION_SQL, "dirty"))
def q_text_association(spark, sf_dir):
    """R1/L1 for text: does a column determine the target, and how strong is the association?"""
    t = text_associations(_with_verdict(spark, sf_dir), DIRTY_TARGET, _ASSOCIATED)
    return t.select("column_name", "n_rows", "n_values", rnd(F.col("repeat_share")).alias("repeat_share"), "determined", rnd(F.col("cramers_v")).alias("cramers_v"))


@register("target_copies", with_fixtures("SELECT 'verdict' AS column_name, count(*) AS n_rows FROM dirty", "dirty"))
def q_target_copies(spark, sf_dir):
    """Columns that say the target in other words; a unique id does not count."""
    d = _with_verdict(spark, sf_dir)
    found = target_copies(text_associations(d, DIRTY_TARGET))
    return d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(",".join(found)).alias("column_name"), "n_rows")


@register("merge_versioned", """WITH base AS (SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 10),
batch AS (SELECT c_custkey, c_name || ' again' AS c_name FROM customer)
SELECT c_custkey, c_name, CAST(2 AS BIGINT) AS version FROM base UNION ALL
SELECT b.c_custkey, b.c_name, 2 FROM batch b ANTI JOIN base USING (c_custkey)""")
def q_merge_versioned(spark, sf_dir):
    """D3: customers of some nations are stored, then all customers are merged by key, and once more, which adds nothing."""
    c = load_table(spark, sf_dir, "customer")
    path = scratch_path(spark, f"versions-{uuid.uuid4().hex}")
    merge_versioned(spark, path, c.where("c_nationkey < 10").select("c_custkey", "c_name"), "c_custkey")
    batch = c.select("c_custkey", F.concat("c_name", F.lit(" again")).alias("c_name"))
    merge_versioned(spark, path, batch, "c_custkey")
    version = merge_versioned(spark, path, batch.union(batch), "c_custkey")
    return read_version(spark, path).withColumn("version", F.lit(version).cast("long"))


@register("text_shaping", """SELECT event_id, printf('%.4f ± %.4f', coalesce(value, 0), CAST(event_id % 7 AS DOUBLE)) AS cell,
  'read ' || event_type || '.csv ok' AS message, event_type AS badge FROM events""")
def q_text_shaping(spark, sf_dir):
    """Score cells, messages without folders, badges."""
    e = load_table(spark, sf_dir, "events")
    message = F.concat(F.lit("read /tmp/some/folder/"), "event_type", F.lit(".csv ok"))
    badges = feature_badges(F.concat(F.lit("a, "), "event_type", F.lit(" ,b")))
    return e.select("event_id", score_cell(F.coalesce("value", F.lit(0.0)), (F.col("event_id") % 7).cast("double")).alias("cell"),
                    redact_paths(message).alias("message"), badges[1].alias("badge"))


@register("default_target", "SELECT 'c_mktsegment' AS target, count(*) AS n_rows FROM customer")
def q_default_target(spark, sf_dir):
    """R8 on a table without a ``churn`` column: its last column."""
    c = load_table(spark, sf_dir, "customer")
    return c.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(default_target(c)).alias("target"), "n_rows")
