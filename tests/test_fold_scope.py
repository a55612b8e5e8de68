"""Preparation inside cross-validation, copies of the target, keyed merges, kernel stage and keyed state."""

import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.operators.association import target_copies, text_associations
from tablesmith.operators.kernel import FourierMap, gamma_of
from tablesmith.operators.knn import knn_neighbours
from tablesmith.plans.fold_scope import FOLD, encode_out_of_fold, fit_prep_by_fold
from tablesmith.plans.prep_fit import fit_prep
from tablesmith.plans.run import run
from tablesmith.plans.spec import PrepPlan
from tablesmith.session import scratch_path
from tablesmith.sources.catalog import current_version, merge_versioned, read_version


def mixed(spark, n=240):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal(5, 3)) if i % 7 else None, float(rng.integers(0, 4)), ["a", "b", "c", None][int(rng.integers(0, 4))],
             f"k{i % 60}", ["x", "y"][i % 2] if i % 11 else None, i % 3, int(rng.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame(rows, "i int, x double, z double, c string, k string, o string, f int, y int")


PLAN = PrepPlan(impute={"x": "median", "z": "mean", "c": "mode", "o": "mode"}, encode={"c": "onehot", "k": "target", "o": "ordinal"}, drop_cols=[])


@pytest.mark.parametrize("scale", ["standard", "minmax"])
def test_fold_specs_equal_fits_without_the_fold(spark, scale):
    df = mixed(spark)
    plan = PrepPlan(**{**PLAN.to_dict(), "scale_strategy": scale})
    specs, rows, _ = fit_prep_by_fold(df, "y", F.col("f"), plan)
    assert set(specs) == {0, 1, 2} and rows.where(F.col(FOLD) != F.col("f")).isEmpty()
    for fold, spec in specs.items():
        want = fit_prep(df.where(F.col("f") != fold), "y", PrepPlan(**{**plan.to_dict(), "drop_cols": []}))
        assert spec.onehot == want.onehot and spec.output_columns == want.output_columns
        assert {c: pytest.approx(v) if isinstance(v, float) else v for c, v in want.fills.items()} == spec.fills
        assert spec.target_maps["k"]["values"] == want.target_maps["k"]["values"]
        assert spec.target_maps["k"]["means"] == pytest.approx(want.target_maps["k"]["means"])
        got, other = ({c: b for c, b in s.clip_bounds.items() if c != "f"} for s in (spec, want))
        assert got.keys() == other.keys() and all(got[c] == pytest.approx(other[c]) for c in got)
        for c in want.scalers:
            if c != "f":
                assert spec.scalers[c][1:] == pytest.approx(want.scalers[c][1:]), c


def test_out_of_fold_means(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("a", 1, 5.0), ("b", 0, 7.0), (None, 1, 9.0), ("b", 0, None)]
    df = spark.createDataFrame(rows, "c string, f int, y double").withColumn("mean", F.lit("clash"))
    got = sorted((r.f, str(r.y), r.c) for r in encode_out_of_fold(df, ["c"], "y", "f").collect())
    rest = {0: (3 + 5 + 9) / 3, 1: (1 + 7) / 2}
    assert got == sorted([(0, "1.0", 4.0), (1, "3.0", 1.0), (1, "5.0", 1.0), (0, "7.0", rest[0]), (1, "9.0", rest[1]), (0, "None", rest[0])])


def test_run_with_fold_scope_and_a_text_copy(spark):
    df = mixed(spark).withColumn("verdict", F.when(F.col("y") == 1, "gone").otherwise("stays")).drop("i", "f")
    r = run(spark, df, "y", models=["LogisticRegression", "GradientBoosting"], tune=True, n_trials=2, fit_scope="fold")
    assert r.dropped_for_leakage == ["verdict"] and r.scores.where("score is null").isEmpty()
    assert r.scores.select("model_id").distinct().count() == 4
    assert {x["rule"] for x in r.concerns.where("column_name = 'verdict'").collect()} >= {"determines_target"}
    r.release()
    with pytest.raises(ValueError, match="fit_scope"):
        run(spark, df, "y", fit_scope="row")


def test_associations_of_odd_columns(spark):
    df = spark.createDataFrame([("u1", "p", None, 0), ("u2", "p", None, 1), ("u3", "q", None, 0), ("u4", None, None, None)], "id string, c string, n string, y int")
    got = {r.column_name: r for r in text_associations(df, "y").collect()}
    assert set(got) == {"id", "c"} and got["id"].determined and got["id"].repeat_share == 0 and not got["c"].determined
    assert target_copies(text_associations(df, "y")) == []
    assert text_associations(df.select("y"), "y").collect() == []


def test_merge_is_idempotent(spark):
    path = scratch_path(spark, f"merge-{uuid.uuid4().hex}")
    batch = lambda rows: spark.createDataFrame(rows, "id string, v int")
    with pytest.raises(FileNotFoundError):
        read_version(spark, path)
    assert merge_versioned(spark, path, batch([("a", 1), ("b", 2), ("b", 1), (None, 5)]), "id") == 1
    assert merge_versioned(spark, path, batch([("a", 9), (None, 7)]), "id") == 1
    assert merge_versioned(spark, path, batch([("a", 9), ("c", 3)]), "id") == 2 == current_version(spark, path)
    assert merge_versioned(spark, path, batch([]), "id") == 2
    rows = lambda v=None: sorted((str(r.id), r.v) for r in read_version(spark, path, v).collect())
    assert rows() == [("None", 5), ("a", 1), ("b", 1), ("c", 3)] and rows(1) == [("None", 5), ("a", 1), ("b", 1)]


def test_random_features_approach_the_kernel(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    x = np.random.default_rng(2).normal(size=(40, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, a array<double>").withColumn("features", array_to_vector("a"))
    lift = FourierMap(0.3, 3, width=20_000)
    z = np.array([r.z for r in lift.lift(df).orderBy("i").select(vector_to_array("features").alias("z")).collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.05
    assert gamma_of(df, "auto", 3) == pytest.approx(1 / 3) and gamma_of(df, "scale", 3) == pytest.approx(1 / (3 * x.var())) and gamma_of(df, 2, 3) == 2.0


@pytest.mark.parametrize("pivots", [1, 5, 60])
def test_grouped_pivots_find_the_exact_neighbours(spark, pivots):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(12, 4)) * 8
    x = np.concatenate([centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 4)) * 0.3, np.tile(centres[0], (40, 1))])
    q = np.concatenate([x[:20], rng.normal(size=(20, 4)) * 10])
    rows = lambda m, at: spark.createDataFrame([(at + i, v.tolist(), i % 3) for i, v in enumerate(m)], "id long, vec array<double>, label int")
    got = {}
    for r in knn_neighbours(rows(x, 0), rows(q, 1000), id_col="id", vec_col="vec", label_col="label", k=7, n_pivots=pivots).collect():
        got.setdefault(r.qid, []).append((r.rn, r.tid))
    d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(len(q)):
        assert [t for _, t in sorted(got[1000 + i])] == sorted(range(len(x)), key=lambda j: (d[i, j], j))[:7]


def test_keyed_state_of_late_and_repeated_events(spark):
    from tablesmith.streaming.state import run_keyed_stream
    base = scratch_path(spark, f"events-{uuid.uuid4().hex}")
    schema = "u string, n long, ts timestamp, kind string, v double"
    batches = [[("a", 3, "10:03", "c", 1.0), ("b", 1, "10:00", "x", None)], [("a", 1, "10:01", "a", 2.0), ("a", 3, "10:03", "c", 1.0)],
               [("a", 2, "10:02", "b", None), ("b", 1, "10:00", "x", None)], [("a", 9, "15:00", None, 4.0), ("b", 5, "15:01", "z", 5.0)],
               [("a", 9, "15:00", None, 4.0), ("a", 10, "15:02", "d", None)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(u, n, f"2024-01-01 {t}:00", k, v) for u, n, t, k, v in rows], schema.replace("timestamp", "string"))
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(os.path.join(base, "src"))
    for time in (None, "ts"):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "src"))
        out = run_keyed_stream(spark, src, "u", "n", ["kind"], ["v"], os.path.join(base, f"sink-{time}"), time=time).collect()
        assert sorted((r.u, r.seq, float(r.value)) for r in out if r.name == "v") == [("a", 1, 2.0), ("a", 3, 1.0), ("a", 9, 4.0), ("b", 5, 5.0)]
        last = {}
        for r in out:
            if r.name == "kind":
                last[r.u] = max(last.get(r.u, (0, "")), (r.seq, r.value))
        assert last == {"a": (10, "d"), "b": (5, "z")}


def test_routed_queries_leave_in_bounded_batches(spark, monkeypatch):
    """A query that needs every cell goes to all of them, in batches that do not grow with the cells."""
    from tablesmith.operators import knn
    x = np.random.default_rng(2).normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, vec array<double>, label int").coalesce(1)
    monkeypatch.setattr(knn, "ROUTE_BYTES", 4096)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 10)
    got = knn_neighbours(df, df.select("id", "vec"), id_col="id", vec_col="vec", label_col="label", k=3, exclude_self=True, n_pivots=40).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag(np.full(600, np.inf))
    want = {(i, int(j)) for i in range(600) for j in np.lexsort((np.arange(600), d[i]))[:3]}
    assert {(r.qid, r.tid) for r in got} == want and len(got) == 1800
