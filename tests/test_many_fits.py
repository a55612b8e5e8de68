"""Fits in shared passes: equal to fits one by one, and to plain optima and splits."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from tablesmith.operators import boosting as B
from tablesmith.operators import many_fits as L
from tablesmith.operators.training import cv_predictions, feature_table, run_battery, score_predictions, tune_models


def frame(spark, x, y, folds=3, parts=2):
    rows = [(i, *map(float, r), float(t), i % folds) for i, (r, t) in enumerate(zip(x, y))]
    names = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ["row_id", *names, "label", "fold"]).repartition(parts)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df).select("row_id", "features", "label", "fold")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(3, 2, 900), rng.normal(0, 50, 900), rng.integers(0, 2, 900)])
    score = 0.8 * (x[:, 0] - 3) - 0.01 * x[:, 1] + x[:, 2] + rng.logistic(size=900)
    return x, score


def test_logistic_fits_equal_spark_ml(spark, points):
    from pyspark.ml.classification import LogisticRegression
    x, score = points
    for classes, y in ((2, (score > 0).astype(int)), (3, np.digitize(score, [-1, 1]))):
        df = frame(spark, x, y)
        fits = [L.LinearFit(f, p) for p in (1e-3, 0.5) for f in range(3)] + [L.LinearFit(None, 0.1), L.LinearFit(1, 0.1, intercept=False)]
        found = L.fit_linear(df, fits, 3, "logistic", classes)
        for fit, w in zip(fits, found):
            train = df if fit.fold is None else df.where(f"fold != {fit.fold}")
            m = LogisticRegression(regParam=fit.penalty, standardization=False, maxIter=2000, tol=1e-12, fitIntercept=fit.intercept).fit(train)
            a, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
            if classes == 3:  # only differences of class scores matter
                a, b, w = a - a.mean(axis=0), b - b.mean(), w - w.mean(axis=0)
            assert np.allclose(w[:, :-1], a, rtol=1e-5, atol=1e-6) and np.allclose(w[:, -1], b, rtol=1e-5, atol=1e-5)


def test_squared_fits_are_least_squares(spark, points):
    x, score = points
    df = frame(spark, x, score)
    for intercept in (True, False):
        fits = [L.LinearFit(f, 0.0, intercept) for f in (0, 1, 2, None)]
        for fit, w in zip(fits, L.fit_linear(df, fits, 3, "squared")):
            keep = np.arange(900) % 3 != fit.fold if fit.fold is not None else np.ones(900, bool)
            z = np.column_stack([x[keep], np.ones(keep.sum())]) if intercept else x[keep]
            want = np.linalg.lstsq(z, score[keep], rcond=None)[0]
            assert np.allclose(w[0][:len(want)], want, rtol=1e-8) and (intercept or w[0][-1] == 0)


def plain_stump(x, y, rate, start):
    """The best first split of logistic boosting by trying every threshold."""
    p = 1 / (1 + np.exp(-start))
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = (-np.inf,)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
            if gain > best[0] + 1e-9:
                best = (gain, f, t, -rate * g[left].sum() / h[left].sum(), -rate * g[~left].sum() / h[~left].sum())
    return best[1:]


def test_first_split_is_the_best_one(spark, points):
    x, score = points
    x, y = np.round(x / [1, 20, 1]), (score > 0).astype(float)
    model = B.fit_model(frame(spark, x, y), 3, B.Boost(rounds=1, depth=1), 2, False)
    tree = model.chains[0][0]
    f, t, low, high = plain_stump(x, y, 0.1, model.starts[0])
    assert (tree["feature"][0], tree["threshold"][0]) == (f, t) and tree["value"][1:] == pytest.approx([low, high])
    assert model.starts[0] == pytest.approx(np.log(y.mean() / (1 - y.mean())))


@pytest.mark.parametrize("numbers", [False, True])
def test_passes_equal_tasks(spark, points, monkeypatch, numbers):
    x, score = points
    df = frame(spark, x, score if numbers else (score > 0).astype(float), parts=3)
    fits = [B.BoostFit(B.Boost(r, 0.3, d, ridge), f, None if numbers else 1) for r, d, ridge in ((1, 1, 0.0), (3, 2, 1.0)) for f in (0, 1, None)]
    names = [f"{f.config.rounds}" for f in fits]
    one = B.boost(B.blocks_of(df, 3, numbers), fits)
    monkeypatch.setattr(B, "SINGLE_BYTES", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    monkeypatch.setattr(B, "HISTOGRAM_BYTES", 3 * B.BINS * 16 * 4)
    monkeypatch.setattr(B, "REFRESH", 2)
    blocks = B.blocks_of(df, 3, numbers)
    assert blocks.single is None and blocks.df.count() >= 9
    many = B.boost(blocks, fits)
    for i, f in enumerate(fits):
        if f.fold is None:
            for a, b in zip(one.trees[i], many.trees[i]):
                assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
    guesses = lambda done: sorted((r.model_id, r.fold, r.label, round(r.prediction, 6), r.n) for r in B.out_of_fold(done, names).collect())
    total = lambda rows: {(m, f): sum(r[4] for r in rows if r[:2] == (m, f)) for m, f in {r[:2] for r in rows}}
    a, b = guesses(one), guesses(many)
    assert total(a) == {(m, f): 300 for m in ("1", "3") for f in (0, 1)} == total(b)
    if numbers:
        assert a == b
    else:
        merged = lambda rows: sorted((k, sum(r[4] for r in rows if r[:4] == k)) for k in {r[:4] for r in rows})
        assert merged(a) == merged(b)


@pytest.mark.parametrize("numbers", [False, True])
def test_chains_on_cells_equal_chains_on_rows(spark, monkeypatch, numbers):
    """Few distinct codes: the chains advance on their cells, in tasks and over many blocks, and give what the rows give."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.integers(0, 6, 3000), rng.integers(0, 4, 3000)]).astype(float)
    y = np.round(x[:, 0] * (x[:, 1] - 1) + rng.normal(size=3000), 2) if numbers else ((x[:, 0] + x[:, 1] + rng.normal(size=3000) > 4) + (x[:, 1] > 2)).astype(int)
    df = frame(spark, x, y, parts=3).cache()
    whole = [B.Boost(6, 0.3, 2), B.Boost(4, 0.2, 3, 1.0, 1.0)]
    fits = [B.BoostFit(c, f, t) for c in whole for f in (0, 1, None) for t in B.targets_of(3, numbers)]
    part = [B.BoostFit(B.Boost(5, 0.3, 3, 1.0, 1.0, 0.7), f, t) for f in (2, None) for t in B.targets_of(3, numbers)]
    key = lambda t: (t.feature.tolist(), t.bin.tolist(), np.round(t.value, 8).tolist())

    def result(done, fits):
        rows = B.out_of_fold(done, [f"{f.config.rounds}" for f in fits]).collect()
        return ([[key(t) for t in trees] if f.fold is None else None for f, trees in zip(fits, done.trees)],
                sorted((r.model_id, r.fold, r.label, round(r.prediction, 7)) for r in rows for _ in range(r.n)))

    codes, ys, fold = B._arrays(*B.blocks_of(df, 2, numbers).single, 2)
    cells = B.cells_of(codes, len(ys) // 2)
    assert len(cells[0]) == 24
    for fit in fits + part:
        (trees, margins), (same, again) = (B.grow_chain(codes, ys, fold, fit, 0.1, c) for c in (None, cells))
        assert [key(t) for t in trees] == [key(t) for t in same] and np.allclose(margins, again, atol=1e-9)
    alone = result(B.boost(B.blocks_of(df, 2, numbers), fits), fits)
    monkeypatch.setattr(B, "SINGLE_BYTES", 0)
    monkeypatch.setattr(B, "BLOCK_ROWS", 500)
    blocks = B.blocks_of(df, 2, numbers)
    starts = [B._start(blocks, f) for f in part]
    passes = result(B._boost_in_passes(blocks, part, starts), part)
    monkeypatch.setattr(B, "_boost_in_passes", None)  # no pass per tree level
    assert result(B.boost(blocks, fits), fits) == alone
    assert result(B.boost(blocks, part), part) == passes
    df.unpersist()


def test_boosting_learns_and_round_trips(spark, points):
    x, score = points
    ring = (np.hypot(x[:, 0] - 3, x[:, 1] / 25) > 2).astype(float)
    for classes, y in ((2, ring), (3, np.digitize(x[:, 0], [2, 4]).astype(float))):
        df = frame(spark, x, y)
        model = B.fit_model(df, 3, B.Boost(40, 0.3, 3, 1.0, 1.0, 0.8), classes, False)
        from pyspark.ml.functions import vector_to_array
        again = B.BoostedModel.from_json(model.to_json())
        got = df.select("label", again.predict(vector_to_array("features")).alias("p")).collect()
        assert np.mean([r.label == r.p for r in got]) > 0.97


def test_odd_tables_are_boosted(spark):
    empty = frame(spark, np.ones((1, 2)), np.ones(1)).where("row_id < 0")
    assert B.fit_model(empty, 2, B.Boost(2), 2, False).starts == [0.0]
    flat = B.fit_model(frame(spark, np.ones((20, 2)), np.arange(20) % 2), 2, B.Boost(3), 2, False)
    assert all(f == -1 for t in flat.chains[0] for f in t["feature"])


def test_battery_and_tuning_agree_with_single_fits(spark, points):
    x, score = points
    raw = spark.createDataFrame([(*map(float, r), int(s > 0)) for r, s in zip(x[:200], score[:200])], ["a", "b", "c", "y"])
    ft = feature_table(raw, "y", "classification")
    scores = {(r.model_id, r.fold, r.metric): r.score for r in run_battery(ft).collect()}
    assert len(scores) == 6 * 3 * 2
    for m in ("LogisticRegression", "KNN"):  # a boosted slot bins all rows once, a single fit its own rows
        for r in score_predictions(cv_predictions(ft, m, None, 3), ft).collect():
            assert scores[m, r.fold, r.metric] == pytest.approx(r.score, abs=1e-6)
    tuned, params = tune_models(ft, ["KNN", "LogisticRegression", "GradientBoostingDeep"], "f1", n_trials=2, seq=7)
    assert {r.seq for r in tuned.select("seq").distinct().collect()} == {7, 8, 9} and tuned.count() == 18
    for m in ("KNN", "LogisticRegression"):
        for r in score_predictions(cv_predictions(ft, m, params[f"{m} (Tuned)"], 3), ft).collect():
            got = tuned.where((tuned.model_id == f"{m} (Tuned)") & (tuned.fold == r.fold) & (tuned.metric == r.metric)).first().score
            assert got == pytest.approx(r.score, abs=1e-6)
    ft.release()
