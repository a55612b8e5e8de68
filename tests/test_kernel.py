"""Kernel slots: fits in shared passes reach the least loss, leave their folds out, tell several classes apart and survive a bundle."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablesmith.operators import kernel as K


def _data(n=900):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3))
    return x, (x[:, 0] ** 2 + x[:, 1] ** 2 < 1.5).astype(float), 50 + 3 * np.sin(2 * x[:, 0]) + rng.standard_t(2, size=n) / 3


def _table(spark, x, y):
    rows = [(i, i % 3, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, fold int, a array<double>, label double").withColumn("features", array_to_vector("a")).repartition(3)


def _loss(loss, z, y, w, penalty):
    score = z @ w[:-1] + w[-1]
    if loss == "hinge":
        return np.maximum(0, 1 - (2 * y - 1) * score).mean() + penalty / 2 * w[:-1] @ w[:-1]
    r = np.abs(y - score)
    by_scale = [(s + np.where(r < K.EPSILON * s, r * r / s, 2 * K.EPSILON * r - K.EPSILON**2 * s)).mean() for s in np.geomspace(0.05, 5, 400)]
    return min(by_scale) + penalty / 2 * ((w[:-1] * z.std(axis=0)) ** 2).sum()


@pytest.mark.parametrize("loss", ["hinge", "huber"])
def test_shared_passes_reach_the_least_loss(spark, loss):
    x, c, v = _data()
    y = c if loss == "hinge" else v
    fits = [K.KernelFit(K.KernelSlot(loss, 0.01, gamma), f, 1 if loss == "hinge" else None) for gamma in ("scale", "auto") for f in (0, 1, None)]
    fitted = K.fit_kernels(_table(spark, x, y), fits, 3)
    rng = np.random.default_rng(1)
    for fit, (lift, w) in zip(fits, fitted):
        kept = np.ones(len(x), bool) if fit.fold is None else np.arange(len(x)) % 3 != fit.fold
        assert lift.gamma == pytest.approx(1 / (3 * x[kept].var()) if fit.slot.gamma == "scale" else 1 / 3)
        z, answers = lift.image(x[kept]).astype(float), y[kept]
        least = _loss(loss, z, answers, w, 0.01)
        for size in (1.0, 0.1, 0.01):
            for _ in range(10):
                assert least < _loss(loss, z, answers, w + size * rng.normal(size=len(w)) / 16, 0.01) + 1e-3
        assert least < 0.6 * _loss(loss, z, answers, np.append(np.zeros(256), np.median(answers) if loss == "huber" else np.sign(answers.mean() - 0.5)), 0.01)


def test_held_out_rows_do_not_change_a_fit(spark):
    x, c, _ = _data(300)
    other = np.where(np.arange(300) % 3 == 1, 1 - c, c)
    fit = [K.KernelFit(K.KernelSlot("hinge", 0.01, "scale"), 1, 1)]
    (m, a), (_, b) = (K.fit_kernels(_table(spark, x, y), fit, 3)[0] for y in (c, other))
    assert np.abs(m.image(x).astype(float) @ (a - b)[:-1] + (a - b)[-1]).max() < 0.05


def test_what_tasks_send_does_not_grow_with_the_rows(spark):
    """No pass stores random features: the sums of a task are as long for ten times the rows."""
    fit = K.KernelFit(K.KernelSlot("hinge", 0.01, 0.3), None, 1)
    point = [(fit, None, [(np.zeros(257), 1.0)])]
    sizes = {K._add_up(K._rows(_table(spark, *_data(n)[:2])), [K.FourierMap(0.3, 3)], point).shape for n in (30, 300)}
    assert len(sizes) == 1


def test_three_classes_and_the_bundle(spark, tmp_path):
    from tablesmith.operators.training import cv_predictions, feature_table, fit_final_model
    from tablesmith.plans.prep_fit import fit_prep
    from tablesmith.plans.spec import PrepPlan
    from tablesmith.sources.bundle import load_bundle, predict_from_bundle, save_bundle
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 240)
    x = rng.normal(size=(240, 2)) * 0.4 + np.array([[0, 0], [3, 0], [0, 3]])[y]
    df = spark.createDataFrame([(float(a), float(b), "uvw"[k]) for (a, b), k in zip(x, y)], "a double, b double, kind string")
    ft = feature_table(df, "kind", "classification", ["a", "b"], cv=3)
    assert cv_predictions(ft, "SVM", None, 3).agg(F.avg((F.col("label") == F.col("prediction")).cast("int")), F.count("*")).first()[:] >= (0.95, 240)
    model = fit_final_model(ft, "SVM")
    path = save_bundle(spark, model, fit_prep(df, "kind", PrepPlan(scale_strategy="none", iqr_k=None)), str(tmp_path / "bundle"))
    got = predict_from_bundle(load_bundle(spark, path), df).select("a", "b", "prediction")
    assert got.join(df, ["a", "b"]).where("prediction = kind").count() >= 228
    plain = ft.df.select(model.kernel.predict(vector_to_array("features")).alias("p"), "label")
    assert plain.where("p = label").count() >= 228
