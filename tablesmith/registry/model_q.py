"""Model checks: exact KNN (M8) and closed-form linear regression (M2) with oracles; the rest rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators.knn import knn_leave_one_out
from tablesmith.operators.models import CLASSIFIERS, REGRESSORS
from tablesmith.registry import register, with_fixtures
from tablesmith.sources.tables import load_table

_KNN_SQL = """
WITH d AS (
  SELECT q.vec_id AS qid, t.vec_id AS tid, t.label,
         list_reduce(list_transform(list_zip(q.embedding, t.embedding),
                     lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)), lambda a, b: a + b) AS d2
  FROM embeddings q JOIN embeddings t ON q.vec_id <> t.vec_id),
r AS (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM d),
v AS (SELECT qid, label, count(*) AS n FROM r WHERE rn <= 5 GROUP BY qid, label)
SELECT qid AS vec_id, label AS prediction FROM (
  SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS rr FROM v) WHERE rr = 1"""


@register("model_knn", _KNN_SQL)
def q_model_knn(spark, sf_dir):
    """Leave-one-out 5-NN label of every embedding (whole table; exact, pruned by pivot cells)."""
    e = load_table(spark, sf_dir, "embeddings")
    return knn_leave_one_out(e, id_col="vec_id", vec_col="embedding", label_col="label", k=5)


# ---------------------------------------------------------------------------------------------------------------
# Models on the prepared ``dirty`` table (rows-only checks), and the closed-form linear regression (oracle)
# ---------------------------------------------------------------------------------------------------------------

import os  # noqa: E402

from tablesmith.functions.exprs import rnd  # noqa: E402
from tablesmith.operators.metrics import cv_summary  # noqa: E402
from tablesmith.operators.training import (  # noqa: E402
    cv_predictions, feature_table, fit_final_model, run_battery, score_predictions, tune_models,
)
from tablesmith.plans.prep_fit import apply_prep, fit_prep  # noqa: E402
from tablesmith.plans.run import run  # noqa: E402
from tablesmith.session import checkpoint_dir, cut_lineage  # noqa: E402
from tablesmith.sources.bundle import load_bundle, predict_from_bundle, save_bundle  # noqa: E402
from tablesmith.sources.fixtures import DIRTY_TARGET, dirty  # noqa: E402
from tablesmith.streaming.state import appended_items, fold_state, run_keyed_stream, run_state_stream  # noqa: E402


def _prepared(spark, sf_dir, drop_leak: bool = True):
    d = dirty(spark, sf_dir)
    if drop_leak:
        d = d.drop("leaky_churn_copy")
    spec = fit_prep(d, DIRTY_TARGET)
    return apply_prep(d, spec, "train"), spec


def _materialised(df, ft, *cached):
    """Cache a small result and release the feature table (and other caches) it came from: one long session runs
    every check."""
    df = df.persist()
    df.count()
    ft.release()
    for c in cached:
        c.unpersist()
    return df


def _model_scores(model_id: str):
    def q(spark, sf_dir):
        prepped, _ = _prepared(spark, sf_dir)
        ft = feature_table(prepped, DIRTY_TARGET, "classification", cv=3)
        return _fold_facts(ft, cv_predictions(ft, model_id, None, 3))
    return q


def _fold_facts(ft, predictions):
    """Facts of a cross-validation that hold for any right learner, per fold and metric: every row of the fold is
    predicted once, each class model answers with a known class, and the score is a number within its bounds."""
    predictions = predictions.persist()
    scores = score_predictions(predictions, ft)
    low, high = (0.0, 1.0) if ft.labels else (float("-inf"), float("inf"))
    known = F.col("prediction").isin([float(i) for i in range(len(ft.labels))]) if ft.labels else F.col("prediction").isNotNull()
    n = F.count(F.lit(1))
    facts = predictions.groupBy("fold").agg(n.alias("n"), F.count_if(~known).alias("unknown"))
    rows = ft.df.groupBy(F.col("fold").alias("f")).agg(n.alias("rows"))
    facts = facts.join(rows, F.col("fold") == F.col("f")).select("fold", (F.col("n") == F.col("rows")).alias("all_rows"), "unknown")
    out = scores.join(facts, "fold").select("model_id", "fold", "metric", "all_rows", "unknown",
                                            F.col("score").between(low, high).alias("in_range"))
    return _materialised(out, ft, predictions)


def _fold_facts_sql(model_id, metrics):
    return f"""SELECT '{model_id}' AS model_id, CAST(fold AS INTEGER) AS fold, metric, true AS all_rows, CAST(0 AS BIGINT) AS unknown,
  true AS in_range FROM (SELECT unnest([0, 1, 2]) AS fold), (SELECT unnest({metrics!r}) AS metric)
  WHERE (SELECT count(*) FROM orders) > 0"""


for _mid, _key in [("LogisticRegression", "model_logreg"), ("RandomForest", "model_rf"),
                   ("GradientBoosting", "model_gbt"), ("GradientBoostingDeep", "model_gbt_deep"),
                   ("SVM", "model_svc")]:
    register(_key, _fold_facts_sql(_mid, ["accuracy", "f1"]))(_model_scores(_mid))


@register("logreg_balance", """
SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0e0 ELSE 0.0e0 END), 4) AS mean_probability FROM lineitem
GROUP BY l_returnflag""")
def q_logreg_balance(spark, sf_dir):
    """M1: the score equations of an (almost) unpenalised logistic regression on class indicators make the mean predicted
    probability of each group equal its observed share."""
    li = load_table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_returnflag") == "A").cast("int").alias("a"), (F.col("l_returnflag") == "N").cast("int").alias("n"), "l_linestatus")
    ft = feature_table(li, "l_linestatus", "classification", features=["a", "n"], cv=3)
    model = fit_final_model(ft, "LogisticRegression", {"C": 1e6}).spark_model
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    flag = F.when(x[0] == 1, "A").when(x[1] == 1, "N").otherwise("R")
    scored = model.transform(ft.df).select(flag.alias("l_returnflag"), vector_to_array("probability")[1].alias("p"))
    return _materialised(scored.groupBy("l_returnflag").agg(F.round(F.avg("p"), 4).alias("mean_probability")), ft)


@register("model_svr", _fold_facts_sql("SVR", ["mae", "rmse", "r2"]))
def q_model_svr(spark, sf_dir):
    ft = feature_table(load_table(spark, sf_dir, "lineitem"), "l_extendedprice", "regression", cv=3)
    return _fold_facts(ft, cv_predictions(ft, "SVR", None, 3))


@register("model_linreg", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def q_model_linreg(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    ft = feature_table(li, "l_extendedprice", "regression", features=["l_quantity"], cv=3)
    fm = fit_final_model(ft, "LinearRegression")
    m = fm.spark_model
    return spark.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))], "slope double, intercept double")


@register("feature_matrix", """
SELECT CAST(o_custkey AS DOUBLE) AS f0, o_totalprice AS f1, CASE WHEN o_orderstatus = 'F' THEN 0.0e0
  WHEN o_orderstatus = 'O' THEN 1.0e0 ELSE 2.0e0 END AS label FROM orders""")
def q_feature_matrix(spark, sf_dir):
    o = load_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    ft = feature_table(o, "o_orderstatus", "classification", cv=3)
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array("features")
    return ft.df.select(arr[0].alias("f0"), arr[1].alias("f1"), "label")


_NULLS = ["annual_income", "tenure_months", "age"]


@register("feature_matrix_nulls", with_fixtures("""WITH r AS (SELECT age, annual_income, tenure_months, churn FROM dirty WHERE churn IS NOT NULL),
m AS (SELECT quantile_cont(annual_income, 0.5) AS a, quantile_cont(tenure_months, 0.5) AS t FROM r)
SELECT round(coalesce(annual_income, a), 6) AS f0, coalesce(tenure_months, t) AS f1, CAST(age AS DOUBLE) AS f2, CAST(churn AS DOUBLE) AS label FROM r, m""", "dirty"))
def q_feature_matrix_nulls(spark, sf_dir):
    """M0 on columns with nulls: they take the column's median."""
    ft = feature_table(dirty(spark, sf_dir).select(*_NULLS, DIRTY_TARGET), DIRTY_TARGET, "classification", _NULLS, cv=3)
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("features")
    return _materialised(ft.df.select(rnd(x[0]).alias("f0"), x[1].alias("f1"), x[2].alias("f2"), "label"), ft)


@register("boost_first_split", """WITH d AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1.0e0 ELSE 0.0e0 END AS y, CAST(l_quantity AS DOUBLE) AS q,
  CAST(l_linenumber AS DOUBLE) AS l FROM lineitem),
p AS (SELECT avg(y) AS p, count(*) AS n, sum(y) AS hits FROM d),
x AS (SELECT 0 AS f, q AS v, y FROM d UNION ALL SELECT 1, l, y FROM d),
c AS (SELECT f, v, count(*) AS n, sum(y) AS hits FROM x GROUP BY f, v),
s AS (SELECT f, v, sum(n) OVER w AS nl, sum(hits) OVER w AS hl FROM c WINDOW w AS (PARTITION BY f ORDER BY v)),
g AS (SELECT f, v, p, (nl * p - hl) AS gl, (n * p - hits) - (nl * p - hl) AS gr, nl * p * (1 - p) AS wl, (n - nl) * p * (1 - p) AS wr
  FROM s, p WHERE nl < n),
b AS (SELECT * FROM g ORDER BY gl * gl / wl + gr * gr / wr DESC, f, v LIMIT 1)
SELECT CAST(f AS BIGINT) AS feature, v AS threshold, round(-0.1 * gl / wl, 6) AS left_value, round(-0.1 * gr / wr, 6) AS right_value,
  round(ln(p / (1 - p)), 6) AS start FROM b""")
def q_boost_first_split(spark, sf_dir):
    """M4: the first split and leaf values of a boosted tree against the best of all splits."""
    li = load_table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber", "l_linestatus")
    ft = feature_table(li, "l_linestatus", "classification", ["l_quantity", "l_linenumber"], cv=3)
    model = fit_final_model(ft, "GradientBoosting", {"n_estimators": 1, "max_depth": 1}).boosted
    tree = model.chains[0][0]
    ft.release()
    return spark.createDataFrame([(tree["feature"][0], tree["threshold"][0], *[round(v, 6) for v in tree["value"][1:]], round(model.starts[0], 6))],
                                 "feature long, threshold double, left_value double, right_value double, start double")


@register("kernel_ring", """SELECT true AS kernel_right, true AS linear_is_majority FROM customer HAVING count(*) > 0""")
def q_kernel_ring(spark, sf_dir):
    """M6: a label inside a ring, which no line separates: the kernel stage finds it, a linear model does no better than the majority."""
    c = load_table(spark, sf_dir, "customer")
    x, y = (F.col("c_acctbal") - 4500) / 3200, (F.col("c_nationkey") - 12) / 7.0
    ring = c.select(x.alias("x"), y.alias("y"), (x * x + y * y < 1.2).cast("int").alias("inside"))
    ft = feature_table(ring, "inside", "classification", cv=3)
    score = {r["model_id"]: r["mean_score"] for r in cv_summary(run_battery(ft, ["SVM", "LogisticRegression"])).where("metric = 'accuracy'").collect()}
    share = ring.agg(F.avg("inside")).first()[0]
    ft.release()
    return spark.createDataFrame([(score["SVM"] > 0.9, score["LogisticRegression"] < max(share, 1 - share) + 0.05)], "kernel_right boolean, linear_is_majority boolean")


#: Rows of the prepared ``dirty`` table without its leak: distinct ones with a target, the dropped columns aside.
_PREPARED_ROWS = """(SELECT count(*) FROM (SELECT DISTINCT age, annual_income, tenure_months, monthly_usage_gb, segment, region,
  credit_score_text, signup_date, churn FROM dirty WHERE churn IS NOT NULL))"""
_BATTERY_SQL = f"""SELECT model_id, metric, CAST(3 AS BIGINT) AS n_folds, true AS in_range, {_PREPARED_ROWS} AS n_rows FROM
  (SELECT unnest({CLASSIFIERS!r}) AS model_id), (SELECT unnest(['accuracy', 'f1']) AS metric)"""


@register("battery", with_fixtures(_BATTERY_SQL, "dirty"))
def q_battery(spark, sf_dir):
    """Every slot scored on every fold of the whole prepared table; scores lie between 0 and 1."""
    prepped, _ = _prepared(spark, sf_dir)
    ft = feature_table(prepped, DIRTY_TARGET, "classification", cv=3)
    s = cv_summary(run_battery(ft, cv=3))
    return _materialised(s.select("model_id", "metric", "n_folds", F.col("mean_score").between(0, 1).alias("in_range"),
                                  F.lit(ft.n_rows).cast("long").alias("n_rows")), ft)


@register("knn_cv_duplicates", """
SELECT CAST(fold AS INTEGER) AS fold, CAST(0 AS BIGINT) AS missing, true AS all_rows FROM (SELECT unnest([0, 1, 2]) AS fold)
WHERE (SELECT count(*) FROM customer) > 0""")
def q_knn_cv_duplicates(spark, sf_dir):
    """M8 in cross-validation on a table of repeated rows: as many predictions as rows."""
    c = load_table(spark, sf_dir, "customer").select(F.col("c_acctbal"), (F.col("c_nationkey") % 3).alias("y"))
    ft = feature_table(c.union(c).union(c), "y", "classification", cv=3)
    p = cv_predictions(ft, "KNN", None, 3)
    n = F.count(F.lit(1))
    folds = ft.df.groupBy(F.col("fold").alias("f")).agg(n.alias("rows"))
    out = p.groupBy("fold").agg(n.alias("n"), F.count_if(F.col("prediction").isNull()).alias("missing")).join(folds, F.col("fold") == F.col("f"))
    return _materialised(out.select("fold", "missing", (F.col("n") == F.col("rows")).alias("all_rows")), ft)


@register("leak_beside_onehot", """
SELECT 'kind_code' AS dropped, CAST(2 AS INTEGER) AS attempts FROM customer HAVING count(*) > 0""")
def q_leak_beside_onehot(spark, sf_dir):
    """L3: a leaking number whose name begins like a one-hot column's; only the number is dropped."""
    c = load_table(spark, sf_dir, "customer")
    y = (F.col("c_custkey") % 2).alias("y")
    d = c.select(F.concat(F.lit("k"), F.col("c_nationkey") % 4).alias("kind"), (F.col("c_custkey") % 2 * 2 + 1).alias("kind_code"), "c_acctbal", y)
    r = run(spark, d, "y", models=["LogisticRegression"], tune=False)
    out = spark.createDataFrame([(",".join(r.dropped_for_leakage), r.attempts)], "dropped string, attempts int")
    r.release()
    return out


@register("tune", """SELECT model_id, metric, CAST(3 AS BIGINT) AS n_folds, true AS in_space, true AS as_recomputed
  FROM (SELECT unnest(['LogisticRegression (Tuned)', 'KNN (Tuned)']) AS model_id), (SELECT unnest(['accuracy', 'f1']) AS metric)
  WHERE (SELECT count(*) FROM orders) > 0""")
def q_tune(spark, sf_dir):
    """M11 on two slots: the best trial's parameters lie in the slot's space, and its fold scores are those of fits one by one."""
    prepped, _ = _prepared(spark, sf_dir)
    ft = feature_table(prepped, DIRTY_TARGET, "classification", cv=3)
    scores, params = tune_models(ft, ["LogisticRegression", "KNN"], "f1", cv=3, n_trials=10)
    fine = {"LogisticRegression (Tuned)": 1e-4 <= params["LogisticRegression (Tuned)"]["C"] <= 1e2, "KNN (Tuned)": 3 <= params["KNN (Tuned)"]["n_neighbors"] <= 15}
    again = {(m, r["metric"]): r["mean_score"] for m in fine for r in cv_summary(score_predictions(
        cv_predictions(ft, m.replace(" (Tuned)", ""), params[m], 3), ft)).collect()}
    rows = [(r["model_id"], r["metric"], r["n_folds"], fine[r["model_id"]], abs(r["mean_score"] - again[r["model_id"], r["metric"]]) < 1e-6)
            for r in cv_summary(scores).collect()]
    ft.release()
    return spark.createDataFrame(rows, "model_id string, metric string, n_folds long, in_space boolean, as_recomputed boolean")


@register("automl_run", f"""SELECT model_id, metric, CAST(3 AS BIGINT) AS n_folds, 'leaky_churn_copy' AS dropped_for_leakage, 2 AS attempts,
  true AS reported FROM (SELECT unnest({CLASSIFIERS!r}) AS model_id), (SELECT unnest(['accuracy', 'f1']) AS metric)
  WHERE (SELECT count(*) FROM orders) > 0""")
def q_automl_run(spark, sf_dir):
    """End to end on ``dirty`` with the leak kept: the leakage loop must drop ``leaky_churn_copy``, the full battery runs, the
    two best models are tuned with ten trials each, and the report and the bundle are written."""
    folder = _bundle_dir(spark, "run")
    r = run(spark, dirty(spark, sf_dir), DIRTY_TARGET, report_path=f"{folder}/report", bundle_path=f"{folder}/bundle")
    reported = not spark.read.text(f"{folder}/report").isEmpty() and load_bundle(spark, f"{folder}/bundle")["target"] == DIRTY_TARGET
    s = cv_summary(r.scores).where(~F.col("model_id").contains("(Tuned)"))
    out = s.select("model_id", "metric", "n_folds", F.lit(",".join(r.dropped_for_leakage)).alias("dropped_for_leakage"),
                   F.lit(r.attempts).alias("attempts"), F.lit(reported).alias("reported")).persist()
    out.count()
    r.release()
    return out


def _bundle_dir(spark, name):
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    import uuid
    return os.path.join(checkpoint_dir(spark), "bundles", f"{name}-{uuid.uuid4().hex[:12]}")


def _trained_bundle(spark, sf_dir):
    d = dirty(spark, sf_dir).drop("leaky_churn_copy")
    spec = fit_prep(d, DIRTY_TARGET)
    prepped = apply_prep(d, spec, "train")
    ft = feature_table(prepped, DIRTY_TARGET, "classification", cv=3)
    fm = fit_final_model(ft, "RandomForest")
    path = _bundle_dir(spark, "bundle")
    save_bundle(spark, fm, spec, path)
    loaded = load_bundle(spark, path)
    return loaded, {**loaded, "model": fm.forest, "spec": spec}


def _same_rows(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@register("bundle_roundtrip", with_fixtures("""
SELECT 'RandomForest' AS model_id, 'classification' AS problem_type, 'churn' AS target,
  CAST(9 + count(DISTINCT segment) + count(DISTINCT region) AS INTEGER) AS n_features,
  string_agg(DISTINCT CAST(churn AS VARCHAR), ',' ORDER BY CAST(churn AS VARCHAR)) AS labels FROM dirty""", "dirty"))
def q_bundle_roundtrip(spark, sf_dir):
    """Five numbers, four date parts and the one-hot columns come back as the model's features."""
    b, _ = _trained_bundle(spark, sf_dir)
    return spark.createDataFrame([(b["model_id"], b["problem_type"], b["target"], len(b["features"]),
                                   ",".join(str(x) for x in b["labels"]))],
                                 "model_id string, problem_type string, target string, n_features int, labels string")


_SCORED_SQL = with_fixtures("SELECT customer_id, true AS scored, true AS agrees FROM dirty", "dirty")


def _scored_rows(scored, other):
    scored, other = cut_lineage(scored), cut_lineage(other)  # scored once, compared and returned
    return scored.select("customer_id", F.col("prediction").isin(0, 1).alias("scored"), F.lit(_same_rows(scored, other)).alias("agrees"))


@register("score_batch", _SCORED_SQL)
def q_score_batch(spark, sf_dir):
    """Every raw row (nulls, duplicates and all) gets one prediction, keyed by ``customer_id``, and the loaded bundle
    predicts what the model in memory does."""
    b, memory = _trained_bundle(spark, sf_dir)
    scored, other = (predict_from_bundle(x, dirty(spark, sf_dir), keep=["customer_id"]).select("customer_id", "prediction") for x in (b, memory))
    return _scored_rows(scored, other)


@register("score_stream", _SCORED_SQL)
def q_score_stream(spark, sf_dir):
    """The same scoring on a stream of ``orders`` files agrees with batch scoring row for row."""
    b, _ = _trained_bundle(spark, sf_dir)
    orders_schema = load_table(spark, sf_dir, "orders").schema
    src = spark.readStream.schema(orders_schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    from tablesmith.sources.fixtures import DIRTY_SQL
    stream_dirty = spark.sql(DIRTY_SQL, orders=src)
    scored = predict_from_bundle(b, stream_dirty, keep=["customer_id"]).select("customer_id", "prediction")
    sink = _bundle_dir(spark, "stream")
    qy = scored.writeStream.format("parquet").outputMode("append").option("path", sink) \
        .option("checkpointLocation", sink + "-checkpoint").trigger(availableNow=True).start()
    qy.awaitTermination()
    batch = predict_from_bundle(b, dirty(spark, sf_dir), keep=["customer_id"]).select("customer_id", "prediction")
    return _scored_rows(spark.read.schema(scored.schema).parquet(sink), batch)


@register("fold_state", "SELECT user_id, max_by(event_type, event_id) AS last_event_type, count(value) AS n_value "
                        "FROM events GROUP BY user_id")
def q_fold_state(spark, sf_dir):
    return fold_state(load_table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"], ["value"])


@register("fold_state_stream", "SELECT user_id, max_by(event_type, event_id) AS last_event_type, "
                               "count(value) AS n_value FROM events GROUP BY user_id")
def q_fold_state_stream(spark, sf_dir):
    """ST1 as a streaming aggregation (update mode, state store) over the ``events`` file."""
    ev = load_table(spark, sf_dir, "events")
    src = spark.readStream.schema(ev.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return run_state_stream(spark, src, "user_id", "event_id", ["event_type"], ["value"], _bundle_dir(spark, "state"))


@register("state_appended", "SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL")
def q_state_appended(spark, sf_dir):
    """ST1: the values of an append key, one row each in a run's order of ``event_id``."""
    return appended_items(load_table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@register("state_keyed_stream", "SELECT user_id, event_id AS seq, 'value' AS name, CAST(round(value, 6) AS DOUBLE) AS value FROM events WHERE value IS NOT NULL "
          "UNION ALL SELECT user_id, max(event_id), 'event_type', NULL FROM events GROUP BY user_id")
def q_state_keyed_stream(spark, sf_dir):
    """ST1 with keyed state: all events twice, dealt over micro-batches in any order, give every appended value once and the last
    event type of each user."""
    ev = load_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    src = _bundle_dir(spark, "shuffled")
    ev.union(ev).repartition(4, F.xxhash64("event_id", F.rand(3))).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    updates = run_keyed_stream(spark, stream, "user_id", "event_id", ["event_type"], ["value"], _bundle_dir(spark, "keyed"))
    values = updates.where("name = 'value'").select("user_id", "seq", "name", rnd(F.col("value").cast("double")).alias("value"))
    last = updates.where("name = 'event_type'").groupBy("user_id").agg(F.max("seq").alias("seq"))
    return values.unionByName(last.select("user_id", "seq", F.lit("event_type").alias("name"), F.lit(None).cast("double").alias("value")))


@register("battery_summary", """SELECT 'customer' AS dataset, 'Success' AS status, 'regression' AS problem_type, true AS chosen_from_all, false AS all_passed
  FROM customer HAVING count(*) > 0 UNION ALL SELECT 'supplier', 'Success', 'classification', true, false FROM supplier HAVING count(*) > 0
  UNION ALL SELECT 'region', 'Failed: ValueError', NULL, NULL, false FROM region HAVING count(*) > 0""")
def q_battery_summary(spark, sf_dir):
    """PIPE-5 + A20: the run with the full battery over three tables side by side, detected problem types, one summary row each; a table
    without a numeric feature fails and is a row like the others."""
    from tablesmith.plans.run import battery_summary, run_many
    c, s, r = (load_table(spark, sf_dir, t) for t in ("customer", "supplier", "region"))
    datasets = {"customer": (c.select("c_nationkey", "c_mktsegment", "c_acctbal"), "c_acctbal"),
                "supplier": (s.select("s_acctbal", "s_suppkey", (F.col("s_nationkey") % 2).alias("half")), "half"),
                "region": (r.select("r_name"), "r_name")}
    summary = run_many(spark, datasets, tune=False, side_by_side=3)
    flag = battery_summary(summary).collect()[0]
    known = F.col("best_model").isin(CLASSIFIERS + REGRESSORS)
    return summary.select("dataset", "status", "problem_type", known.alias("chosen_from_all"), F.lit(bool(flag["all_passed"])).alias("all_passed"))
