"""Profiling checks (A1–A9, R1) on the ``dirty`` view and driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.exprs import rnd
from tablesmith.operators import profile as P
from tablesmith.registry import duck_num, duck_ts, register, union_all, with_fixtures
from tablesmith.sources.fixtures import DIRTY_COLUMNS, DIRTY_TARGET, dirty
from tablesmith.sources.tables import load_table

# column -> kind for the oracle side ('num' numeric, 'str' text)
DIRTY_KINDS = {"customer_id": "str", "age": "num", "annual_income": "num", "tenure_months": "num",
               "monthly_usage_gb": "num", "segment": "str", "region": "str", "credit_score_text": "str",
               "signup_date": "str", "leaky_churn_copy": "num", "churn": "num", "all_null_feature": "num",
               "legacy_flag": "str"}
DIRTY_STATIC = {"age": "int64", "annual_income": "float64", "tenure_months": "float64",
                "monthly_usage_gb": "float64", "leaky_churn_copy": "float64", "churn": "int64",
                "all_null_feature": "float64"}


def _duck_dtype(c: str) -> str:
    if c in DIRTY_STATIC:
        return f"'{DIRTY_STATIC[c]}'"
    nn = f"count({c})"
    num = f"count({duck_num(c, 'str')})"
    dtc = f"count({duck_ts(c)})"
    return (f"CASE WHEN {nn} = 0 THEN 'object' WHEN {num} > 0 AND {num} < {nn} THEN 'mixed_numeric' "
            f"WHEN {num} = {nn} THEN 'numeric_string' WHEN {dtc} / {nn} >= 0.9 THEN 'datetime_string' "
            f"ELSE 'object' END")


_MISS = union_all([f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END), 6) "
                   f"AS missing_fraction FROM dirty" for c in DIRTY_COLUMNS])
_CARD = union_all([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS cardinality FROM dirty"
                   for c in DIRTY_COLUMNS])
_DTYPE = union_all([f"SELECT '{c}' AS column_name, {_duck_dtype(c)} AS dtype" + ("" if c in DIRTY_STATIC else
                    " FROM dirty") for c in DIRTY_COLUMNS])


@register("profile_shape", with_fixtures("SELECT count(*) AS n_rows, 13 AS n_columns FROM dirty", "dirty"))
def q_profile_shape(spark, sf_dir):
    return P.profile_shape(dirty(spark, sf_dir))


@register("missingness", with_fixtures(_MISS, "dirty"))
def q_missingness(spark, sf_dir):
    m = P.missingness(dirty(spark, sf_dir))
    return m.select("column_name", rnd(F.col("missing_fraction")).alias("missing_fraction"))


@register("cardinality", with_fixtures(_CARD, "dirty"))
def q_cardinality(spark, sf_dir):
    return P.cardinality(dirty(spark, sf_dir))


@register("infer_dtypes", with_fixtures(_DTYPE, "dirty"))
def q_infer_dtypes(spark, sf_dir):
    return P.infer_dtypes(dirty(spark, sf_dir))


@register("profile_columns", with_fixtures(
    f"SELECT d.column_name, d.dtype, m.missing_fraction, c.cardinality FROM ({_DTYPE}) d "
    f"JOIN ({_MISS}) m USING (column_name) JOIN ({_CARD}) c USING (column_name)", "dirty"))
def q_profile_columns(spark, sf_dir):
    p = P.column_profile(dirty(spark, sf_dir))
    return p.select("column_name", "dtype", rnd(F.col("missing_fraction")).alias("missing_fraction"),
                    "cardinality")


def _duck_ptype(table: str, col: str, numeric: bool) -> str:
    rule = ("CASE WHEN count({c}) = 0 THEN NULL " + ("" if numeric else "WHEN TRUE THEN 'classification' ") +
            "WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) / count({c}) <= 0.05 THEN 'classification' "
            "ELSE 'regression' END").format(c=col)
    return (f"SELECT '{col}' AS target, {rule} AS problem_type, count({col}) AS n_non_null, "
            f"count(DISTINCT {col}) AS n_unique FROM {table}")


_PTYPE_TARGETS = [("dirty", "churn", True), ("lineitem", "l_quantity", True), ("lineitem", "l_extendedprice", True),
                  ("events", "event_type", False), ("events", "value", True), ("customer", "c_mktsegment", False)]


@register("problem_type", with_fixtures(union_all([_duck_ptype(t, c, n) for t, c, n in _PTYPE_TARGETS]), "dirty"))
def q_problem_type(spark, sf_dir):
    frames = []
    for t, c, _ in _PTYPE_TARGETS:
        df = dirty(spark, sf_dir) if t == "dirty" else load_table(spark, sf_dir, t)
        frames.append(P.problem_type_frame(df, c))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("target_balance", with_fixtures(
    "SELECT CAST(churn AS VARCHAR) AS label, count(*) AS n, "
    "round(count(*) / sum(count(*)) OVER (), 6) AS proportion FROM dirty WHERE churn IS NOT NULL GROUP BY churn",
    "dirty"))
def q_target_balance(spark, sf_dir):
    b = P.target_balance(dirty(spark, sf_dir), DIRTY_TARGET, "classification")
    return b.select("label", "n", rnd(F.col("proportion")).alias("proportion"))


_NUMERIC_DIRTY = ["age", "annual_income", "tenure_months", "monthly_usage_gb", "credit_score_text",
                  "leaky_churn_copy", "churn"]


def _duck_pair(a: str, b: str) -> str:
    xa, xb = duck_num(a, DIRTY_KINDS[a]), duck_num(b, DIRTY_KINDS[b])
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) "
            f"AS corr FROM (SELECT CASE WHEN vb IS NOT NULL THEN va END AS x, CASE WHEN va IS NOT NULL THEN vb END "
            f"AS y FROM (SELECT {xa} AS va, {xb} AS vb FROM dirty))")


_PAIRS = [(a, b) for a in _NUMERIC_DIRTY for b in _NUMERIC_DIRTY if a < b]
_CORR_MATRIX = union_all([_duck_pair(a, b) for a, b in _PAIRS])


@register("corr_flags", with_fixtures(
    f"SELECT col_a, col_b, round(corr, 6) AS corr FROM ({_CORR_MATRIX}) WHERE abs(corr) >= 0.9", "dirty"))
def q_corr_flags(spark, sf_dir):
    return P.correlation_flags(dirty(spark, sf_dir), DIRTY_TARGET, threshold=0.9)


@register("outliers_iqr", with_fixtures("""
WITH q AS (SELECT quantile_cont(monthly_usage_gb, 0.25) AS q1, quantile_cont(monthly_usage_gb, 0.75) AS q3 FROM dirty),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'monthly_usage_gb' AS column_name, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound,
       count(*) FILTER (WHERE monthly_usage_gb < lo OR monthly_usage_gb > hi) AS n_outliers,
       round(count(*) FILTER (WHERE monthly_usage_gb < lo OR monthly_usage_gb > hi) / count(*), 6) AS outlier_fraction
FROM dirty, b GROUP BY lo, hi""", "dirty"))
def q_outliers_iqr(spark, sf_dir):
    o = P.outliers_iqr(dirty(spark, sf_dir), "monthly_usage_gb", k=1.5)
    return o.select("column_name", rnd(F.col("lower_bound")).alias("lower_bound"),
                    rnd(F.col("upper_bound")).alias("upper_bound"), "n_outliers",
                    rnd(F.col("outlier_fraction")).alias("outlier_fraction"))


_CONCERNS = f"""
WITH prof AS (SELECT d.column_name, d.dtype, m.missing_fraction, c.cardinality FROM ({_DTYPE}) d
  JOIN ({_MISS}) m USING (column_name) JOIN ({_CARD}) c USING (column_name)),
n AS (SELECT count(*) AS n FROM dirty),
flags AS (SELECT col_a, col_b, round(corr, 6) AS corr FROM ({_CORR_MATRIX}) WHERE abs(corr) >= 0.9)
SELECT column_name, 'all_null' AS rule, missing_fraction AS value FROM prof
  WHERE column_name <> 'churn' AND missing_fraction = 1.0
UNION ALL
SELECT column_name, 'constant', CAST(cardinality AS DOUBLE) FROM prof
  WHERE column_name <> 'churn' AND cardinality <= 1 AND missing_fraction < 1.0
UNION ALL
SELECT column_name, 'identifier', CAST(cardinality AS DOUBLE) FROM prof, n
  WHERE column_name <> 'churn' AND column_name IN ('customer_id','segment','region','credit_score_text',
    'signup_date','legacy_flag') AND cardinality = n.n AND n.n > 1
UNION ALL
SELECT CASE WHEN col_a = 'churn' THEN col_b ELSE col_a END, 'target_correlation', corr FROM flags
  WHERE col_a = 'churn' OR col_b = 'churn'
"""


@register("concerns", with_fixtures(_CONCERNS, "dirty"))
def q_concerns(spark, sf_dir):
    return P.concerns(dirty(spark, sf_dir), DIRTY_TARGET)


@register("cardinality_big_keys", """
SELECT 'big' AS column_name, count(DISTINCT o_orderkey) AS cardinality FROM orders
UNION ALL SELECT 'small', count(DISTINCT o_orderkey % 7) FROM orders""")
def q_cardinality_big_keys(spark, sf_dir):
    """A3 on integers that a double cannot tell apart."""
    o = load_table(spark, sf_dir, "orders").select((F.lit(2**60) + F.col("o_orderkey")).alias("big"), (F.col("o_orderkey") % 7).alias("small"))
    return P.cardinality(o)


@register("corr_flags_nan", """
SELECT 'copy' AS col_a, 'l_quantity' AS col_b, 1.0e0 AS corr FROM lineitem HAVING count(*) > 0""")
def q_corr_flags_nan(spark, sf_dir):
    """A copy of the target with NaN and infinite values in it is still flagged."""
    li = load_table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.when(
        F.col("l_orderkey") % 5 == 0, F.lit(float("nan"))).when(F.col("l_orderkey") % 7 == 0, F.lit(float("inf")))
        .otherwise(F.col("l_quantity").cast("double")).alias("copy"))
    return P.correlation_flags(li, "l_quantity")


@register("balance_order", """
SELECT row_number() OVER (ORDER BY n DESC, label) AS position, label FROM (
  SELECT CAST(l_returnflag AS VARCHAR) AS label, count(*) AS n FROM lineitem GROUP BY l_returnflag)""")
def q_balance_order(spark, sf_dir):
    """Class shares come largest first."""
    rows = P.target_balance(load_table(spark, sf_dir, "lineitem"), "l_returnflag", "classification")
    return rows.coalesce(1).select((F.monotonically_increasing_id() + 1).alias("position"), "label")
