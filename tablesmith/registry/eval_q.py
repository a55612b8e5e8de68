"""Evaluation checks: folds (W1, W2), metrics (A16–A18), leaderboards (T3–T6), leakage (L1, L2), metric rule.

Fold scores are computed from three rule predictors over ``events`` (the label is ``event_type``):
``UserRule`` (a type picked by ``user_id``), ``IdRule`` (picked by ``event_id``) and ``TargetCopy`` (the label itself,
the leakage case).  Folds are the W2 hash folds of ``event_id``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions.exprs import rnd
from tablesmith.operators import leaderboard as LB
from tablesmith.operators import metrics as M
from tablesmith.operators.folds import hash_folds, stratified_folds
from tablesmith.operators.labels import fit_labels
from tablesmith.operators.leakage import leakage_correlations
from tablesmith.operators.rules import choose_metric
from tablesmith.registry import register, with_fixtures
from tablesmith.sources.fixtures import DIRTY_TARGET, dirty
from tablesmith.sources.tables import load_table

_H = "('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT"


@register("folds_kfold", f"SELECT event_id, CAST({_H.format(k='event_id')} % 3 AS INTEGER) AS fold FROM events")
def q_folds_kfold(spark, sf_dir):
    return hash_folds(load_table(spark, sf_dir, "events").select("event_id"), "event_id", 3)


@register("folds_stratified", f"""
SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY {_H.format(k='event_id')} % 8,
  {_H.format(k='event_id')}, event_id) - 1) % 3 AS INTEGER) AS fold FROM events""")
def q_folds_stratified(spark, sf_dir):
    e = load_table(spark, sf_dir, "events").select("event_id", "event_type")
    return stratified_folds(e, "event_id", "event_type", k=3, buckets=8)


@register("metric_accuracy", "SELECT round(avg(CASE WHEN quality = toxic THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy "
                             "FROM labels")
def q_metric_accuracy(spark, sf_dir):
    m = M.classification_metrics(load_table(spark, sf_dir, "labels"), "quality", "toxic")
    return m.select(rnd(F.col("accuracy")).alias("accuracy"))


@register("metric_f1_binary", """
SELECT round(CASE WHEN pp + ap = 0 THEN 0.0e0 ELSE 2.0e0 * tp / (pp + ap) END, 6) AS f1 FROM (
  SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE toxic = 1) AS pp,
         count(*) FILTER (WHERE quality = 1) AS ap FROM labels)""")
def q_metric_f1_binary(spark, sf_dir):
    m = M.classification_metrics(load_table(spark, sf_dir, "labels"), "quality", "toxic", average="binary")
    return m.select(rnd(F.col("f1")).alias("f1"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def _duck_pick(expr: str) -> str:
    return "CASE " + expr + " % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES[:-1])) + \
        f" ELSE '{_TYPES[-1]}' END"


@register("metric_f1_macro", f"""
WITH t AS (SELECT event_type AS y, {_duck_pick('event_id')} AS p FROM events),
cm AS (SELECT y, p, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY y, p),
l AS (SELECT y AS v FROM cm UNION SELECT p FROM cm),
s AS (SELECT l.v, coalesce(sum(CASE WHEN cm.y = l.v AND cm.p = l.v THEN n END), 0) AS tp,
      coalesce(sum(CASE WHEN cm.p = l.v THEN n END), 0) AS pp, coalesce(sum(CASE WHEN cm.y = l.v THEN n END), 0) AS ap
      FROM l, cm GROUP BY l.v)
SELECT round(avg(CASE WHEN pp + ap = 0 THEN 0 ELSE 2 * tp / (pp + ap) END), 6) AS f1,
       (SELECT round(avg(CASE WHEN y = p THEN 1.0e0 ELSE 0.0e0 END), 6) FROM t) AS accuracy FROM s""")
def q_metric_f1_macro(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    types = fit_labels(e, "event_type")
    pred = F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("event_id") % len(types) + 1).cast("int"))
    m = M.classification_metrics(e.withColumn("pred", pred), "event_type", "pred", average="macro")
    return m.select(rnd(F.col("f1")).alias("f1"), rnd(F.col("accuracy")).alias("accuracy"))


@register("metric_regression", """
SELECT round(avg(abs(l_quantity * 1500 - l_extendedprice)), 6) AS mae,
       round(sqrt(avg(power(l_quantity * 1500 - l_extendedprice, 2))), 6) AS rmse,
       round(1 - sum(power(l_quantity * 1500 - l_extendedprice, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2
FROM lineitem""")
def q_metric_regression(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").withColumn("pred", F.col("l_quantity") * 1500)
    m = M.regression_metrics(li, "l_extendedprice", "pred")
    return m.select(*[rnd(F.col(c)).alias(c) for c in ("mae", "rmse", "r2")])


# ---------------------------------------------------------------------------------------------------------------
# Fold scores of the rule predictors and everything computed from them
# ---------------------------------------------------------------------------------------------------------------

_MODELS = [("UserRule", 1), ("IdRule", 2), ("TargetCopy", 3)]


def rule_fold_scores(spark, sf_dir):
    """``(model_id, fold, metric, score, seq)`` of the rule predictors under 3 hash folds of ``events``."""
    e = hash_folds(load_table(spark, sf_dir, "events"), "event_id", 3)
    types = fit_labels(e, "event_type")
    arr = F.array(*[F.lit(t) for t in types])
    preds = {
        "UserRule": F.element_at(arr, (F.col("user_id") % len(types) + 1).cast("int")),
        "IdRule": F.element_at(arr, (F.col("event_id") % len(types) + 1).cast("int")),
        "TargetCopy": F.col("event_type"),
    }
    scores = M.fold_scores(e, "event_type", preds, "fold", "classification", labels=types)
    seq = F.create_map(*[x for m, s in _MODELS for x in (F.lit(m), F.lit(s))])
    return scores.withColumn("seq", seq[F.col("model_id")])


_DUCK_SCORES = f"""
WITH p AS (SELECT {_H.format(k='event_id')} % 3 AS fold, event_type AS y, {_duck_pick('user_id')} AS p_user,
           {_duck_pick('event_id')} AS p_id, event_type AS p_copy FROM events),
long AS (SELECT 'UserRule' AS model_id, fold, y, p_user AS p FROM p UNION ALL
         SELECT 'IdRule', fold, y, p_id FROM p UNION ALL SELECT 'TargetCopy', fold, y, p_copy FROM p),
cm AS (SELECT model_id, fold, y, p, count(*) AS n FROM long GROUP BY model_id, fold, y, p),
acc AS (SELECT model_id, fold, sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n) AS accuracy FROM cm
        GROUP BY model_id, fold),
lab AS (SELECT model_id, fold, y AS label, CASE WHEN y = p THEN n ELSE 0 END AS tp, 0 AS pp, n AS ap FROM cm
        UNION ALL SELECT model_id, fold, p, 0, n, 0 FROM cm),
pl AS (SELECT model_id, fold, label, sum(tp) AS tp, sum(pp) AS pp, sum(ap) AS ap FROM lab
       GROUP BY model_id, fold, label),
f1 AS (SELECT model_id, fold, avg(CASE WHEN pp + ap = 0 THEN 0.0e0 ELSE 2.0e0 * tp / (pp + ap) END) AS f1 FROM pl
       GROUP BY model_id, fold),
seqs AS (SELECT * FROM (VALUES ('UserRule', 1), ('IdRule', 2), ('TargetCopy', 3)) t(model_id, seq)),
scores AS (SELECT model_id, CAST(fold AS INTEGER) AS fold, 'accuracy' AS metric, accuracy AS score FROM acc
           UNION ALL SELECT model_id, CAST(fold AS INTEGER), 'f1', f1 FROM f1),
summ AS (SELECT model_id, metric, avg(score) AS mean_score, stddev_pop(score) AS std_score, count(score) AS n_folds
         FROM scores GROUP BY model_id, metric)
"""


@register("cv_scores", _DUCK_SCORES + "SELECT model_id, fold, metric, round(score, 6) AS score FROM scores")
def q_cv_scores(spark, sf_dir):
    s = rule_fold_scores(spark, sf_dir)
    return s.select("model_id", "fold", "metric", rnd(F.col("score")).alias("score"))


@register("cv_summary", _DUCK_SCORES + "SELECT model_id, metric, round(mean_score, 6) AS mean_score, "
                                       "round(std_score, 6) AS std_score, n_folds FROM summ")
def q_cv_summary(spark, sf_dir):
    s = M.cv_summary(rule_fold_scores(spark, sf_dir))
    return s.select("model_id", "metric", rnd(F.col("mean_score")).alias("mean_score"),
                    rnd(F.col("std_score")).alias("std_score"), "n_folds")


@register("leaderboard_top2", _DUCK_SCORES + """
SELECT model_id, seq, round(mean_score, 6) AS mean_score FROM seqs LEFT JOIN (SELECT * FROM summ WHERE metric = 'f1')
  USING (model_id) ORDER BY mean_score DESC NULLS LAST, seq LIMIT 2""")
def q_leaderboard_top2(spark, sf_dir):
    t = LB.top_candidates(rule_fold_scores(spark, sf_dir), "f1", 2)
    return t.select("model_id", "seq", rnd(F.col("mean_score")).alias("mean_score"))


@register("best_model", _DUCK_SCORES + """
SELECT model_id FROM seqs LEFT JOIN (SELECT * FROM summ WHERE metric = 'accuracy') USING (model_id)
ORDER BY mean_score DESC NULLS LAST, seq LIMIT 1""")
def q_best_model(spark, sf_dir):
    return LB.best_model(rule_fold_scores(spark, sf_dir), "accuracy")


@register("headline_score", _DUCK_SCORES + """
SELECT model_id, printf('%.4f ± %.4f (F1)', mean_score, coalesce(std_score, 0.0)) AS headline FROM summ
WHERE model_id = 'UserRule' AND metric = 'f1'""")
def q_headline_score(spark, sf_dir):
    return LB.headline_score(rule_fold_scores(spark, sf_dir), "UserRule")


_CELL = "printf('%.4f ± %.4f', mean_score, coalesce(std_score, 0.0))"


@register("leaderboard_pivot", _DUCK_SCORES + "SELECT model_id, " + ", ".join(
    f"coalesce(max(CASE WHEN metric = '{m}' THEN {_CELL} END), 'N/A') AS {m}" for m in LB.KNOWN_METRICS) +
    ", contains(model_id, '(Tuned)') AS tuned FROM summ GROUP BY model_id")
def q_leaderboard_pivot(spark, sf_dir):
    return LB.leaderboard_pivot(rule_fold_scores(spark, sf_dir))


@register("leakage_scores", _DUCK_SCORES + """
SELECT model_id, metric, round(mean_score, 6) AS mean_score FROM summ
WHERE metric IN ('accuracy', 'f1') AND mean_score >= 1.0 AND NOT (starts_with(model_id, 'SVM') OR
  starts_with(model_id, 'SVR'))""")
def q_leakage_scores(spark, sf_dir):
    f = LB.perfect_score_flags(rule_fold_scores(spark, sf_dir), "classification")
    return f.select("model_id", "metric", rnd(F.col("mean_score")).alias("mean_score"))


@register("leakage_corr", with_fixtures("""
SELECT 'leaky_churn_copy' AS feature, round(r, 6) AS corr FROM (
  SELECT covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS r FROM (
    SELECT CASE WHEN churn IS NOT NULL THEN leaky_churn_copy END AS x,
           CASE WHEN leaky_churn_copy IS NOT NULL THEN CAST(churn AS DOUBLE) END AS y FROM dirty))
WHERE abs(r) >= 0.99""", "dirty"))
def q_leakage_corr(spark, sf_dir):
    return leakage_correlations(dirty(spark, sf_dir), DIRTY_TARGET)


@register("choose_metric", with_fixtures("""
SELECT 'churn' AS target, CASE WHEN max(n) / sum(n) > 0.6 THEN 'f1' ELSE 'accuracy' END AS metric
  FROM (SELECT count(*) AS n FROM dirty WHERE churn IS NOT NULL GROUP BY churn)
UNION ALL
SELECT 'event_type', CASE WHEN max(n) / sum(n) > 0.6 THEN 'f1' ELSE 'accuracy' END
  FROM (SELECT count(*) AS n FROM events GROUP BY event_type)
UNION ALL SELECT 'l_extendedprice', 'r2'""", "dirty"))
def q_choose_metric(spark, sf_dir):
    a = choose_metric(dirty(spark, sf_dir), DIRTY_TARGET)
    b = choose_metric(load_table(spark, sf_dir, "events"), "event_type")
    c = choose_metric(load_table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return a.unionByName(b).unionByName(c)
