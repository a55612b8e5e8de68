"""Training (M0, M10–M12): feature matrix, cross-validated battery, random-search tuning, final refit.

The feature table (assembled vector, encoded label, fold) is built once and persisted; every fit of the battery
reads it.  Fits of different (model, configuration, fold) triples run as concurrent Spark jobs from one queue, the way
``CrossValidator(parallelism=...)`` does, and each is scored as soon as it is fitted.  Linear, kernel and boosted slots fit all folds and
configurations in shared passes (``many_fits``, ``kernel``, ``boosting``), a forest all folds (``forest``); KNN searches once per fold for all configurations.
"""

from __future__ import annotations

import logging
import math
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.exprs import qcol
from tablesmith.operators import boosting, forest, kernel
from tablesmith.operators import metrics as M
from tablesmith.operators.boosting import Boost, BoostedModel, BoostFit
from tablesmith.operators.forest import Forest, ForestModel
from tablesmith.operators.folds import buckets_for, hash_folds, stratified_folds
from tablesmith.operators.kernel import KernelFit, KernelModel, KernelSlot
from tablesmith.operators.knn import knn_neighbours, knn_predict, knn_votes
from tablesmith.operators.labels import encode_target
from tablesmith.operators.many_fits import MOST_WIDTH, LinearFit, fit_linear, score_linear
from tablesmith.operators.models import BOOSTED, ESTIMATOR_HOOKS, KERNELS, KNNConfig, build_estimator, sample_params, slots
from tablesmith.operators.quantiles import quantiles
from tablesmith.operators.selection import numeric_features
from tablesmith.session import cut_lineage, persist

log = logging.getLogger(__name__)

PARTITION_BYTES = 64 << 20
MIN_PARTITION_ROWS = 20_000
# Fits that run side by side at least.
PARALLEL_FITS = 3
# Slots whose configurations and folds are fitted in shared passes, with their loss.
SHARED_SCAN = {"LogisticRegression": "logistic", "LinearRegression": "squared"}
# Slots in the order in which their fits join the queue.
COSTLIEST = ["RandomForest", "GradientBoostingDeep", "GradientBoosting", "KNN", "SVM", "SVR"]


@dataclass
class FeatureTable:
    df: DataFrame                      # (row_id, features VECTOR, label DOUBLE, fold INT)
    features: list[str]
    medians: dict[str, float]
    labels: list | None                # classification labels in code order
    problem_type: str
    n_rows: int
    extra: dict = field(default_factory=dict)

    def release(self) -> None:
        self.df.unpersist()


def feature_table(df: DataFrame, target: str, problem_type: str, features: list[str] | None = None,
                  cv: int = 3, labels: list | None = None) -> FeatureTable:
    """M0: numeric features (residual nulls -> column median), encoded label, folds, assembled vector."""
    feats = [c for c in (features or numeric_features(df, target)) if c != target]
    if not feats:
        raise ValueError("No numeric features available to train the model battery.")
    df = df.where(qcol(target).isNotNull())
    med = quantiles(df, {c: qcol(c).cast("double") for c in feats}, [0.5])
    medians = {c: (v[0] if v[0] is not None else 0.0) for c, v in med.items()}
    content = F.xxhash64(*[qcol(c) for c in df.columns])
    cols = [F.coalesce(qcol(c).cast("double"), F.lit(medians[c])).alias(f"f{i}") for i, c in enumerate(feats)]
    if problem_type == "classification":
        df, labels = encode_target(df, target, "__y", labels)
        y = F.col("__y")
    else:
        labels = None
        y = qcol(target).cast("double")
    # folds hash the row's content, so they do not depend on row order or partitioning; equal rows share that hash, so
    # the row key is another one: a unique number, written once together with the rows and never computed again
    base = cut_lineage(df.select(F.monotonically_increasing_id().alias("row_id"), content.alias("__content"),
                                 *cols, y.alias("label")))
    n, largest = base.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first() \
        if problem_type == "classification" else (base.count(), 0)
    if problem_type == "classification":
        folded = stratified_folds(base, "__content", "label", k=cv, buckets=buckets_for(largest))
    else:
        folded = hash_folds(base, "__content", k=cv)
    vec = VectorAssembler(inputCols=[f"f{i}" for i in range(len(feats))], outputCol="features",
                          handleInvalid="error").transform(folded).select("row_id", "features", "label", "fold")
    parts = training_partitions(df.sparkSession, n, len(feats))
    vec = persist(cut_lineage(vec.repartition(parts, "row_id")))
    return FeatureTable(vec, feats, medians, labels, problem_type, n, {"partitions": parts})


def assemble(df: DataFrame, target: str, problem_type: str, feats: list[str], fills: dict[str, float], labels: list | None, fold: str) -> FeatureTable:
    """A feature table of rows whose folds are given already."""
    cols = [F.coalesce(qcol(c).cast("double"), F.lit(fills[c])).alias(f"f{i}") for i, c in enumerate(feats)]
    y = qcol(target).cast("double")
    if problem_type == "classification":
        df, labels = encode_target(df, target, "__y", labels)
        y = F.col("__y")
    rows = df.select(F.monotonically_increasing_id().alias("row_id"), *cols, y.alias("label"), qcol(fold).cast("int").alias("fold"))
    vec = VectorAssembler(inputCols=[f"f{i}" for i in range(len(feats))], outputCol="features", handleInvalid="error").transform(rows)
    vec = cut_lineage(vec.select("row_id", "features", "label", "fold"))
    n = vec.count()
    parts = training_partitions(df.sparkSession, n, len(feats))
    vec = persist(vec.repartition(parts, "row_id"))
    return FeatureTable(vec, feats, fills, labels, problem_type, n, {"partitions": parts})


def training_partitions(spark, rows: int, n_features: int) -> int:
    """Partitions of a feature table: every learner runs one task per partition in each of its many passes, so there
    are as many as ``PARTITION_BYTES`` asks for, and on small tables one per ``MIN_PARTITION_ROWS`` rows up to the cores."""
    by_size = -(-rows * (8 * n_features + 32) // PARTITION_BYTES)
    return int(max(1, by_size, min(spark.sparkContext.defaultParallelism, rows // MIN_PARTITION_ROWS)))


def _estimator(ft: FeatureTable, model_id: str, params: dict | None, n_train: int):
    """The slot's estimator for ``n_train`` rows; a forest is not told them and may grow leaves of one row at any size."""
    told = {} if model_id == "RandomForest" and model_id not in ESTIMATOR_HOOKS else {"n_train": n_train}
    return build_estimator(model_id, ft.problem_type, params, n_classes=len(ft.labels or []), **told)


def _predict(ft: FeatureTable, est, train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit on ``train``; ``(row_id, label, prediction)`` for ``test``."""
    if isinstance(est, KNNConfig):
        corpus = train.select("row_id", vector_to_array("features").alias("vec"), "label")
        qs = test.select("row_id", vector_to_array("features").alias("vec"))
        pred = knn_predict(corpus, qs, id_col="row_id", vec_col="vec", label_col="label", k=est.k,
                           weights=est.weights, problem_type=ft.problem_type)
        return test.select("row_id", "label").join(pred, "row_id").select(
            "row_id", "label", F.col("prediction").cast("double").alias("prediction"))
    if isinstance(est, Boost):
        model = boosting.fit_model(train, len(ft.features), est, len(ft.labels or []), ft.labels is None)
        return test.select("row_id", "label", model.predict(vector_to_array("features")).alias("prediction"))
    if isinstance(est, Forest):
        model = forest.fit_model(train, len(ft.features), est, len(ft.labels or []), ft.labels is None)
        return test.select("row_id", "label", model.predict(vector_to_array("features")).alias("prediction"))
    if isinstance(est, KernelSlot):
        model = kernel.fit_model(train, len(ft.features), est, len(ft.labels or []), ft.labels is None)
        return test.select("row_id", "label", model.predict(vector_to_array("features")).alias("prediction"))
    model = est.fit(train)
    return model.transform(test).select("row_id", "label", F.col("prediction").cast("double").alias("prediction"))


def cv_predictions(ft: FeatureTable, model_id: str, params: dict | None = None, cv: int = 3,
                   pool: ThreadPoolExecutor | None = None) -> DataFrame:
    """Out-of-fold predictions ``(model_id, fold, label, prediction)`` of one configuration."""
    if model_id not in ESTIMATOR_HOOKS and (model_id == "RandomForest" or model_id in (*BOOSTED, *KERNELS)):
        shared = _boosted_predictions if model_id in BOOSTED else _kernel_predictions if model_id in KERNELS else _forest_predictions
        counted = shared(ft, model_id, [params or {}], cv, [model_id])
        return counted.select("model_id", "fold", "label", "prediction", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("col")

    def one(f: int) -> DataFrame:
        train = ft.df.where(F.col("fold") != f)
        test = ft.df.where(F.col("fold") == f)
        est = _estimator(ft, model_id, params, int(ft.n_rows * (cv - 1) / cv))
        return _predict(ft, est, train, test).withColumn("fold", F.lit(f))

    parts = list(pool.map(one, range(cv))) if pool else [one(f) for f in range(cv)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("model_id", F.lit(model_id))


def _wide_to_long(wide: DataFrame, metrics: tuple) -> DataFrame:
    return wide.select("model_id", F.col("fold").cast("int").alias("fold"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in metrics])))


def score_counts(counted: DataFrame, ft: FeatureTable) -> DataFrame:
    """Long scores from predictions that are counted already: rows ``(model_id, fold, label, prediction, n)``."""
    average = "binary" if len(ft.labels) <= 2 else "macro"
    pos = "1.0" if average == "binary" and len(ft.labels) > 1 else None
    cm = counted.groupBy("model_id", "fold", F.col("label").cast("string").alias("y"), F.col("prediction").cast("string").alias("p")).agg(F.sum("n").alias("n"))
    return _wide_to_long(M.classification_scores(cm, ["model_id", "fold"], average, pos), M.CLASSIFICATION_METRICS)


def score_predictions(pred: DataFrame, ft: FeatureTable) -> DataFrame:
    """Long scores ``(model_id, fold, metric, score)`` from out-of-fold predictions (one aggregation)."""
    if ft.problem_type == "classification":
        return score_counts(pred.select("model_id", "fold", "label", "prediction", F.lit(1).alias("n")), ft)
    wide = M.regression_scores(pred, F.col("label"), F.col("prediction"), [F.col("model_id"), F.col("fold")])
    return _wide_to_long(wide, M.REGRESSION_METRICS)


def fits_at_once(ft: FeatureTable, parallelism: int | None) -> int:
    """Concurrent fits: as many as the cores hold at one task per partition, unless the caller says."""
    return parallelism or max(PARALLEL_FITS, ft.df.sparkSession.sparkContext.defaultParallelism // max(1, ft.extra.get("partitions", 1)))


def shares_scan(ft: FeatureTable, model_id: str) -> bool:
    """Can all configurations and folds of the slot be fitted in shared passes?"""
    outputs = 1 if not ft.labels or len(ft.labels) <= 2 else len(ft.labels)
    return model_id in SHARED_SCAN and model_id not in ESTIMATOR_HOOKS and outputs * (len(ft.features) + 1) <= MOST_WIDTH


def _metric_rows(scores: DataFrame) -> dict[str, list[tuple]]:
    """``{model_id: [(fold, metric, score)]}`` of a long score table (folds x metrics rows per model)."""
    out: dict[str, list[tuple]] = {}
    for r in scores.collect():
        out.setdefault(r["model_id"], []).append((r["fold"], r["metric"], r["score"]))
    return out


def _shared_scan_scores(ft: FeatureTable, model_id: str, trials: list[dict], cv: int) -> list[list[tuple]]:
    """Fold scores of every configuration of a linear slot: all (configuration, fold) fits in the same passes."""
    loss, n_train = SHARED_SCAN[model_id], max(1, int(ft.n_rows * (cv - 1) / cv))
    fits = [LinearFit(f, 1.0 / (t.get("C", 1.0) * n_train) if loss == "logistic" else 0.0, bool(t.get("fit_intercept", True)))
            for t in trials for f in range(cv)]
    names = [str(i) for i in range(len(trials)) for _ in range(cv)]
    weights = fit_linear(ft.df, fits, len(ft.features), loss, len(ft.labels or []))
    scored = score_linear(ft.df, fits, names, weights, loss)
    found = _metric_rows(score_counts(scored, ft) if ft.problem_type == "classification" else score_predictions(scored, ft))
    return [found.get(str(i), []) for i in range(len(trials))]


def _boosted_predictions(ft: FeatureTable, model_id: str, trials: list[dict], cv: int, names: list[str]) -> DataFrame:
    """Counted out-of-fold predictions of configurations of a boosted slot: all chains advance in the same passes."""
    numbers = ft.labels is None
    chains = boosting.targets_of(len(ft.labels or []), numbers)
    models = [(name, BoostFit(build_estimator(model_id, ft.problem_type, t), f, c)) for name, t in zip(names, trials) for f in range(cv) for c in chains]
    done = boosting.boost(boosting.blocks_of(ft.df, len(ft.features), numbers, ft.extra), [fit for _, fit in models])
    return boosting.out_of_fold(done, [name for name, _ in models])


def _kernel_predictions(ft: FeatureTable, model_id: str, trials: list[dict], cv: int, names: list[str]) -> DataFrame:
    """Counted out-of-fold predictions of configurations of a kernel slot: all fits advance in the same passes."""
    classes, n = len(ft.labels or []), int(ft.n_rows * (cv - 1) / cv)
    slots_ = [build_estimator(model_id, ft.problem_type, t, n_train=n, n_classes=classes) for t in trials]
    fits = [(name, KernelFit(s, f, c)) for name, s in zip(names, slots_) for f in range(cv) for c in kernel.targets_of(classes, ft.labels is None)]
    fitted = kernel.fit_kernels(ft.df, [fit for _, fit in fits], len(ft.features))
    return kernel.out_of_fold(ft.df, [fit for _, fit in fits], fitted, [name for name, _ in fits])


def _forest_predictions(ft: FeatureTable, model_id: str, trials: list[dict], cv: int, names: list[str]) -> DataFrame:
    """Counted out-of-fold predictions of one configuration of the forest: the trees of all folds grow in the same passes."""
    numbers = ft.labels is None
    est = _estimator(ft, model_id, trials[0], int(ft.n_rows * (cv - 1) / cv))
    blocks = boosting.blocks_of(ft.df, len(ft.features), numbers, ft.extra)
    return forest.predict_folds(blocks, est, list(range(cv)), len(ft.labels or []), numbers, names[0])


def _counted_scores(ft: FeatureTable, counted: DataFrame, names: list[str]) -> list[list[tuple]]:
    found = _metric_rows(score_predictions(counted, ft) if ft.labels is None else score_counts(counted, ft))
    return [found.get(name, []) for name in names]


def _boosted_scores(ft: FeatureTable, model_id: str, trials: list[dict], cv: int) -> list[list[tuple]]:
    """Fold scores of every configuration of a boosted slot."""
    names = [str(i) for i in range(len(trials))]
    return _counted_scores(ft, _boosted_predictions(ft, model_id, trials, cv, names), names)


def _kernel_scores(ft: FeatureTable, model_id: str, trials: list[dict], cv: int) -> list[list[tuple]]:
    """Fold scores of every configuration of a kernel slot."""
    names = [str(i) for i in range(len(trials))]
    return _counted_scores(ft, _kernel_predictions(ft, model_id, trials, cv, names), names)


def _forest_scores(ft: FeatureTable, model_id: str, trials: list[dict], cv: int) -> list[list[tuple]]:
    """Fold scores of every configuration of the forest, one after the other, so that the trees of one are held at a time."""
    return [_counted_scores(ft, _forest_predictions(ft, model_id, [t], cv, ["0"]), ["0"])[0] for t in trials]


def _neighbour_scores(ft: FeatureTable, trials: list[dict], cv: int, pool: ThreadPoolExecutor) -> list[list[tuple]]:
    """Fold scores of every KNN configuration from one search per fold with the largest k: all of them vote on its neighbours."""
    configs = [(t.get("n_neighbors", 5), t.get("weights", "uniform")) for t in trials]

    def one(f: int) -> dict[str, list[tuple]]:
        test = ft.df.where(F.col("fold") == f)
        corpus = ft.df.where(F.col("fold") != f).select("row_id", vector_to_array("features").alias("vec"), "label")
        near = knn_neighbours(corpus, test.select("row_id", vector_to_array("features").alias("vec")), id_col="row_id", vec_col="vec",
                              label_col="label", k=max(k for k, _ in configs))
        votes = knn_votes(cut_lineage(near), configs, ft.problem_type)
        pred = test.select(F.col("row_id").alias("qid"), "label", "fold").join(votes, "qid").select(
            F.col("config").cast("string").alias("model_id"), "fold", "label", F.col("prediction").cast("double").alias("prediction"))
        return _metric_rows(score_predictions(pred, ft))

    folds = list(pool.map(one, range(cv)))
    return [[row for found in folds for row in found.get(str(i), [])] for i in range(len(trials))]


def _fold_scores(ft: FeatureTable, model_id: str, params: dict | None, fold: int, cv: int) -> list[tuple]:
    """``(fold, metric, score)`` of one fit, scored as soon as it is fitted, so that the model can go."""
    est = _estimator(ft, model_id, params, int(ft.n_rows * (cv - 1) / cv))
    pred = _predict(ft, est, ft.df.where(F.col("fold") != fold), ft.df.where(F.col("fold") == fold))
    pred = pred.withColumn("fold", F.lit(fold)).withColumn("model_id", F.lit(model_id))
    return _metric_rows(score_predictions(pred, ft)).get(model_id, [])


def _configuration_scores(ft: FeatureTable | dict[int, FeatureTable], model_id: str, trials: list[dict], cv: int, pool: ThreadPoolExecutor,
                          fits: ThreadPoolExecutor) -> Future:
    """A future of the fold scores per configuration (None for one that failed). Fits run in ``fits``; ``pool`` holds the threads that wait.
    Where every fold has a table of its own, each fit is one of its own as well."""
    by_fold = ft if isinstance(ft, dict) else {f: ft for f in range(cv)}
    carry = inheritable_thread_target(any_table(ft).df.sparkSession)
    if isinstance(ft, dict):
        pass
    elif shares_scan(ft, model_id):
        return fits.submit(carry(_shared_scan_scores), ft, model_id, trials, cv)
    elif model_id in BOOSTED and model_id not in ESTIMATOR_HOOKS:
        return fits.submit(carry(_boosted_scores), ft, model_id, trials, cv)
    elif model_id in KERNELS and model_id not in ESTIMATOR_HOOKS:
        return fits.submit(carry(_kernel_scores), ft, model_id, trials, cv)
    elif model_id == "RandomForest" and model_id not in ESTIMATOR_HOOKS:
        return fits.submit(carry(_forest_scores), ft, model_id, trials, cv)
    elif model_id == "KNN" and model_id not in ESTIMATOR_HOOKS:
        return pool.submit(carry(_neighbour_scores), ft, trials, cv, fits)
    parts = [[fits.submit(carry(_fold_scores), by_fold[f], model_id, t, f, cv) for f in sorted(by_fold)] for t in trials]

    def gather() -> list[list[tuple] | None]:
        out: list[list[tuple] | None] = []
        for t, futures in zip(trials, parts):
            try:
                out.append([row for x in futures for row in x.result()])
            except Exception as e:  # noqa: BLE001 - one failing configuration must not stop the others
                log.warning("%s with %s failed: %s", model_id, t, e)
                out.append(None)
        return out

    return pool.submit(gather)


def any_table(ft: FeatureTable | dict[int, FeatureTable]) -> FeatureTable:
    return next(iter(ft.values())) if isinstance(ft, dict) else ft


def _score_frame(ft: FeatureTable | dict[int, FeatureTable], rows: list[tuple]) -> DataFrame:
    return any_table(ft).df.sparkSession.createDataFrame(rows, "model_id string, fold int, metric string, score double, seq int")


def run_battery(ft: FeatureTable | dict[int, FeatureTable], models: list[str] | None = None, cv: int = 3, parallelism: int | None = None) -> DataFrame:
    """K-fold CV of every slot; a failing model is logged and skipped.  Returns the long score table
    ``(model_id, fold, metric, score, seq)``: a row per model, fold and metric.

    All (model, fold) fits wait in one queue for ``parallelism`` threads, the costliest slots first; each is scored as
    soon as it is fitted. Linear, kernel and boosted slots fit all folds in shared passes. ``ft`` may be a table per fold
    (``fit_scope="fold"``): a fold is then scored by models of its own table.
    """
    models = models or slots(any_table(ft).problem_type)
    rows = []
    with ThreadPoolExecutor(len(models)) as pool, ThreadPoolExecutor(fits_at_once(any_table(ft), parallelism)) as fits:
        waiting = {}
        for m in sorted(models, key=lambda m: COSTLIEST.index(m) if m in COSTLIEST else len(COSTLIEST)):
            waiting[m] = _configuration_scores(ft, m, [{}], cv, pool, fits)
        for i, m in enumerate(models):
            try:
                found = waiting[m].result()[0]
            except Exception as e:  # noqa: BLE001 - one failing model must not stop the battery
                log.warning("model %s failed: %s", m, e)
                found = None
            rows += [(m, f, metric, score, i + 1) for f, metric, score in found or []]
    if not rows:
        raise RuntimeError("every model of the battery failed")
    return _score_frame(ft, rows)


def tune_models(ft: FeatureTable | dict[int, FeatureTable], model_ids: list[str], metric: str, cv: int = 3, n_trials: int = 10, seed: int = 42,
                parallelism: int | None = None, seq: int = 1) -> tuple[DataFrame, dict[str, dict]]:
    """Seeded random search of several slots; each trial is cross-validated on the same folds, a failing trial scores
    +/-inf. Returns the fold scores (all metrics) of each slot's best trial under ``"<model_id> (Tuned)"`` and its parameters.

    The fits of all slots, trials and folds share one queue. A linear slot fits all trials in shared passes, KNN
    searches once per fold for all of them. The best trial keeps the scores that chose it.
    """
    smaller = metric in M.SMALLER_IS_BETTER
    rows, best_params = [], {}
    with ThreadPoolExecutor(len(model_ids)) as pool, ThreadPoolExecutor(fits_at_once(any_table(ft), parallelism)) as fits:
        trials = {m: sample_params(m, n_trials, seed) for m in model_ids}
        waiting = {m: _configuration_scores(ft, m, trials[m], cv, pool, fits) for m in model_ids}
        for i, m in enumerate(model_ids):
            try:
                results = waiting[m].result()
            except Exception as e:  # noqa: BLE001
                log.warning("tuning of %s failed: %s", m, e)
                continue

            def rank(j: int, results=results) -> tuple:
                values = [s for _, name, s in results[j] or [] if name == metric and s is not None]
                mean = sum(values) / len(values) if values else math.inf if smaller else -math.inf
                return (mean if smaller else -mean, j)

            best = min(range(len(results)), key=rank)
            if results[best] is None:
                log.warning("every trial of %s failed", m)
                continue
            name = f"{m} (Tuned)"
            best_params[name] = trials[m][best]
            rows += [(name, f, metric_name, score, seq + i) for f, metric_name, score in results[best]]
    return _score_frame(ft, rows), best_params


def tune_model(ft: FeatureTable, model_id: str, metric: str, cv: int = 3, n_trials: int = 10, seed: int = 42,
               parallelism: int | None = None) -> tuple[DataFrame, dict]:
    """M11 for one slot: the best trial's fold scores ``(model_id, fold, metric, score)`` and its parameters."""
    scores, params = tune_models(ft, [model_id], metric, cv, n_trials, seed, parallelism)
    return scores.drop("seq"), params[f"{model_id} (Tuned)"]


@dataclass
class FittedModel:
    model_id: str
    problem_type: str
    features: list[str]
    medians: dict[str, float]
    labels: list | None
    params: dict
    spark_model: object = None        # fitted Spark ML model (not KNN)
    knn_corpus: DataFrame | None = None  # (row_id, vec, label) for KNN
    boosted: BoostedModel | None = None
    forest: ForestModel | None = None
    kernel: KernelModel | None = None


def fit_final_model(ft: FeatureTable, model_id: str, params: dict | None = None) -> FittedModel:
    """Refit the winner on all rows (the "(Tuned)" suffix is stripped)."""
    base_id = model_id.replace(" (Tuned)", "")
    n_classes = len(ft.labels) if ft.labels else 0
    est = _estimator(ft, base_id, params, ft.n_rows)
    fm = FittedModel(base_id, ft.problem_type, ft.features, ft.medians, ft.labels, dict(params or {}))
    if isinstance(est, KNNConfig):
        fm.knn_corpus = ft.df.select("row_id", vector_to_array("features").alias("vec"), "label")
    elif isinstance(est, Boost):
        fm.boosted = boosting.fit_model(ft.df, len(ft.features), est, n_classes, ft.labels is None, ft.extra)
    elif isinstance(est, Forest):
        fm.forest = forest.fit_model(ft.df, len(ft.features), est, n_classes, ft.labels is None, ft.extra)
    elif isinstance(est, KernelSlot):
        fm.kernel = kernel.fit_model(ft.df, len(ft.features), est, n_classes, ft.labels is None)
    else:
        fm.spark_model = est.fit(ft.df)
    return fm
