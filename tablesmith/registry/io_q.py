"""Sources and sinks (S1, S3, S6, S10–S13), request logs (E14, E15), usage (E16, A19), checks (Q1), hooks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tablesmith.functions.exprs import rnd
from tablesmith.functions.text import client_info
from tablesmith.operators import reporting as R
from tablesmith.operators.checks import check_rows, pass_rate
from tablesmith.operators.custom import apply_expressions, apply_pandas
from tablesmith.operators.leakage import leaked_features
from tablesmith.operators.profile import detect_problem_type
from tablesmith.plans.prep_fit import infer_plan
from tablesmith.registry import register, with_fixtures
from tablesmith.registry.eval_q import _DUCK_SCORES, rule_fold_scores
from tablesmith.session import checkpoint_dir
from tablesmith.sources.csv import load_csv, write_csv
from tablesmith.sources.fixtures import DIRTY_COLUMNS, DIRTY_TARGET, dirty, usage_raw, weblog
from tablesmith.sources.logs import append_records, read_records
from tablesmith.sources.snapshot import load_snapshot, save_snapshot
from tablesmith.sources.tables import load_table


def _scratch(spark, name: str) -> str:
    """Fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


@register("src_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                     "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")
def q_src_csv(spark, sf_dir):
    path = _scratch(spark, "orders_csv")
    write_csv(load_table(spark, sf_dir, "orders"), path)
    return load_csv(spark, path)


@register("snapshot_roundtrip", with_fixtures(f"SELECT {', '.join(DIRTY_COLUMNS)} FROM dirty", "dirty"))
def q_snapshot_roundtrip(spark, sf_dir):
    path = _scratch(spark, "snapshot")
    save_snapshot(dirty(spark, sf_dir), path)
    return load_snapshot(spark, path)


def _headers():
    return F.map_from_arrays(
        F.array(F.lit("X-Forwarded-For"), F.lit("X-Real-IP"), F.lit("User-Agent"), F.lit("Accept-Language")),
        F.array("x_forwarded_for", "x_real_ip", "user_agent", "accept_language"))


def _parsed_weblog(spark, sf_dir):
    w = weblog(spark, sf_dir)
    info = client_info(_headers())
    return w.select("req_id", *[e.alias(k) for k, e in info.items() if k != "user_agent"])


_DUCK_IP = ("CASE WHEN x_forwarded_for <> '' THEN trim(split_part(x_forwarded_for, ',', 1)) "
            "WHEN x_real_ip <> '' THEN trim(split_part(x_real_ip, ',', 1)) ELSE '127.0.0.1' END")
_UA = "lower(user_agent)"
_DUCK_BROWSER = (f"CASE WHEN contains({_UA}, 'edg/') OR contains({_UA}, 'edge') THEN 'Edge' "
                 f"WHEN contains({_UA}, 'chrome') AND contains({_UA}, 'safari') THEN 'Chrome' "
                 f"WHEN contains({_UA}, 'safari') AND NOT contains({_UA}, 'chrome') THEN 'Safari' "
                 f"WHEN contains({_UA}, 'firefox') THEN 'Firefox' "
                 f"WHEN contains({_UA}, 'opera') OR contains({_UA}, 'opr/') THEN 'Opera' ELSE 'Other' END")
_DUCK_OS = (f"CASE WHEN contains({_UA}, 'windows') THEN 'Windows' "
            f"WHEN contains({_UA}, 'macintosh') OR contains({_UA}, 'mac os x') THEN 'macOS' "
            f"WHEN contains({_UA}, 'linux') THEN 'Linux' WHEN contains({_UA}, 'android') THEN 'Android' "
            f"WHEN contains({_UA}, 'iphone') OR contains({_UA}, 'ipad') THEN 'iOS' ELSE 'Other' END")
_DUCK_LANG = ("CASE WHEN accept_language IS NULL THEN 'unknown' WHEN contains(accept_language, ',') "
              "THEN trim(split_part(accept_language, ',', 1)) ELSE accept_language END")
_WEBLOG_ALL = (f"SELECT req_id, {_DUCK_IP} AS ip, {_DUCK_BROWSER} AS browser, {_DUCK_OS} AS os, "
               f"{_DUCK_LANG} AS language, 'direct' AS referrer FROM weblog")


@register("weblog_ip", with_fixtures(f"SELECT req_id, {_DUCK_IP} AS ip FROM weblog", "weblog"))
def q_weblog_ip(spark, sf_dir):
    return _parsed_weblog(spark, sf_dir).select("req_id", "ip")


@register("weblog_agent", with_fixtures(
    f"SELECT req_id, {_DUCK_BROWSER} AS browser, {_DUCK_OS} AS os, {_DUCK_LANG} AS language, "
    f"'direct' AS referrer FROM weblog", "weblog"))
def q_weblog_agent(spark, sf_dir):
    return _parsed_weblog(spark, sf_dir).select("req_id", "browser", "os", "language", "referrer")


@register("log_append", with_fixtures(_WEBLOG_ALL + " UNION ALL " + _WEBLOG_ALL, "weblog"))
def q_log_append(spark, sf_dir):
    """Two appends of the parsed request log to one CSV log, read back."""
    parsed = _parsed_weblog(spark, sf_dir)
    path = _scratch(spark, "visitor_log")
    append_records(parsed, path)
    append_records(parsed, path)
    return read_records(spark, path, parsed.schema)


_DUCK_USAGE = """(SELECT event_id, stage,
  CASE WHEN json_extract(payload, '$.usage') IS NOT NULL THEN coalesce(CAST(json_extract(payload, '$.usage.input_tokens') AS BIGINT), 0)
       WHEN json_extract(payload, '$.response.usage_metadata') IS NOT NULL THEN coalesce(CAST(json_extract(payload, '$.response.usage_metadata.prompt_tokens') AS BIGINT), 0)
       WHEN json_extract(payload, '$.response.token_usage') IS NOT NULL THEN coalesce(CAST(json_extract(payload, '$.response.token_usage.prompt_tokens') AS BIGINT), 0)
       ELSE 0 END AS input_tokens,
  CASE WHEN json_extract(payload, '$.usage') IS NOT NULL THEN coalesce(CAST(json_extract(payload, '$.usage.output_tokens') AS BIGINT), 0)
       WHEN json_extract(payload, '$.response.usage_metadata') IS NOT NULL THEN coalesce(CAST(json_extract(payload, '$.response.usage_metadata.candidates_tokens') AS BIGINT), 0)
       WHEN json_extract(payload, '$.response.token_usage') IS NOT NULL THEN coalesce(CAST(json_extract(payload, '$.response.token_usage.completion_tokens') AS BIGINT), 0)
       ELSE 0 END AS output_tokens
FROM usage_raw)"""


@register("usage_normalize", with_fixtures(f"SELECT * FROM {_DUCK_USAGE}", "usage_raw"))
def q_usage_normalize(spark, sf_dir):
    return R.usage_table(usage_raw(spark, sf_dir)).select("event_id", "stage", "input_tokens", "output_tokens")


@register("usage_rollup", with_fixtures(
    f"SELECT stage, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS "
    f"output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, grouping(stage) = 1 AS "
    f"is_total FROM {_DUCK_USAGE} GROUP BY ROLLUP (stage)", "usage_raw"))
def q_usage_rollup(spark, sf_dir):
    return R.usage_rollup(R.usage_table(usage_raw(spark, sf_dir)))


@register("report_lines", _DUCK_SCORES + """
SELECT 'model_battery' AS section, row_number() OVER (ORDER BY seq, model_id, metric) AS line_no,
  printf('| %s | %s | %.4f | %.4f |', model_id, metric, mean_score, coalesce(std_score, 0.0)) AS text
FROM summ JOIN seqs USING (model_id)""")
def q_report_lines(spark, sf_dir):
    return R.score_table_lines(rule_fold_scores(spark, sf_dir)).select(
        "section", F.col("line_no").cast("long").alias("line_no"), "text")


_DUCK_LEDGER = _DUCK_SCORES + """,
led AS (SELECT 'run_rules' AS run_id, translate(model_id, ' ()', '_') || '_' || metric || '_mean' AS name,
               round(mean_score, 6) AS value FROM summ
        UNION ALL SELECT 'run_rules', translate(model_id, ' ()', '_') || '_' || metric || '_std', round(std_score, 6)
        FROM summ)
"""


@register("run_ledger", _DUCK_LEDGER + "SELECT * FROM led")
def q_run_ledger(spark, sf_dir):
    rows = R.ledger_rows("run_rules", rule_fold_scores(spark, sf_dir))
    return rows.select("run_id", "name", rnd(F.col("value")).alias("value"))


@register("ledger_lookup", _DUCK_LEDGER + "SELECT * FROM led")
def q_ledger_lookup(spark, sf_dir):
    """Two runs appended to a ledger partitioned by run id; the lookup reads back one of them."""
    path = _scratch(spark, "ledger")
    scores = rule_fold_scores(spark, sf_dir)
    R.append_ledger(R.ledger_rows("run_rules", scores), path)
    R.append_ledger(R.ledger_rows("run_other", scores.where(F.col("fold") == 0)), path)
    return R.lookup_run(spark, path, "run_rules").select("run_id", "name", rnd(F.col("value")).alias("value"))


@register("preview", "SELECT *, (SELECT count(*) FROM customer) AS n_rows, 5 AS n_columns FROM customer "
                     "ORDER BY c_custkey LIMIT 5")
def q_preview(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    n = c.select(F.count(F.lit(1))).scalar()
    return c.orderBy("c_custkey").limit(5).select("*", n.alias("n_rows"),
                                                  F.lit(len(c.columns)).alias("n_columns"))


def _checks(spark, sf_dir):
    d = dirty(spark, sf_dir)
    leaked = leaked_features(d, DIRTY_TARGET)
    plan = infer_plan(d, DIRTY_TARGET)
    pt = detect_problem_type(d, DIRTY_TARGET)
    rows = [("leakage_detection", "leaky_churn_copy" in leaked, f"flagged: {leaked}"),
            ("imputation_validity", "annual_income" in plan.impute or "tenure_months" in plan.impute,
             f"fills: {sorted(plan.impute)}"),
            ("problem_type_inference", pt == "classification", f"inferred {pt}")]
    frames = [spark.createDataFrame([r], "check_name string, pass boolean, detail string") for r in rows]
    return check_rows(frames)


_DUCK_CHECKS = with_fixtures("""
SELECT 'leakage_detection' AS check_name, coalesce(abs(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0))
  >= 0.99, false) AS pass FROM (SELECT CASE WHEN churn IS NOT NULL THEN leaky_churn_copy END AS x,
  CASE WHEN leaky_churn_copy IS NOT NULL THEN CAST(churn AS DOUBLE) END AS y FROM dirty)
UNION ALL
SELECT 'imputation_validity', count(*) FILTER (WHERE churn IS NOT NULL AND (annual_income IS NULL OR
  tenure_months IS NULL)) > 0 FROM dirty
UNION ALL
SELECT 'problem_type_inference', count(DISTINCT churn) <= 20 OR count(DISTINCT churn) / count(churn) <= 0.05
FROM dirty""", "dirty")


@register("check_results", _DUCK_CHECKS)
def q_check_results(spark, sf_dir):
    return _checks(spark, sf_dir).select("check_name", "pass")


@register("check_pass_rate", "SELECT round(100.0e0 * avg(CASE WHEN pass THEN 1.0e0 ELSE 0.0e0 END), 6) AS pass_rate, "
                             "count(*) AS n_checks FROM (" + _DUCK_CHECKS + ")")
def q_check_pass_rate(spark, sf_dir):
    p = pass_rate(_checks(spark, sf_dir))
    return p.select(rnd(F.col("pass_rate")).alias("pass_rate"), "n_checks")


_CUSTOM = {"unit_price": "l_extendedprice / nullif(l_quantity, 0)", "net_price": "l_extendedprice * (1 - l_discount)"}


@register("custom_expr", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{e} AS {n}" for n, e in _CUSTOM.items()) + " FROM lineitem")
def q_custom_expr(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem")
    out = apply_expressions(li, _CUSTOM)
    return out.select("l_orderkey", "l_linenumber", *_CUSTOM)


@register("custom_pandas", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax, l_extendedprice * l_tax AS tax_amount "
                           "FROM lineitem")
def q_custom_pandas(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax")

    def tax_amount(pdf):
        return pdf.assign(tax_amount=pdf["l_extendedprice"] * pdf["l_tax"])
    return apply_pandas(li, tax_amount, "l_orderkey long, l_linenumber int, l_extendedprice double, l_tax double, "
                                        "tax_amount double")


@register("report_overview", with_fixtures("""
WITH b AS (SELECT CAST(churn AS VARCHAR) AS label, count(*) AS n FROM dirty WHERE churn IS NOT NULL GROUP BY churn)
SELECT 'overview' AS section, CAST(1 AS BIGINT) AS line_no, '- **Problem Type**: classification' AS text
UNION ALL SELECT 'overview', 2, printf('- **Rows**: %d', (SELECT count(*) FROM dirty))
UNION ALL SELECT 'overview', 3, '- **Columns**: 13'
UNION ALL SELECT 'overview', row_number() OVER (ORDER BY n DESC, label) + 3,
  printf('  - `%s`: %.2f%%', label, 100.0e0 * n / (SELECT sum(n) FROM b)) FROM b""", "dirty"))
def q_report_overview(spark, sf_dir):
    from tablesmith.operators.profile import detect_problem_type
    d = dirty(spark, sf_dir)
    return R.overview_lines(d, DIRTY_TARGET, detect_problem_type(d, DIRTY_TARGET))
