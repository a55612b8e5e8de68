"""Exact KNN with pivot pruning and split blocks equals brute force."""

import numpy as np
import pytest

import tablesmith.operators.knn as K
from tests.conftest import SF_SMALL
from tablesmith.sources.tables import load_table


def brute(ids, vecs, labels, k):
    out = {}
    for i, q in enumerate(vecs):
        d = ((vecs - q) ** 2).sum(axis=1)
        d[i] = np.inf
        order = np.lexsort((ids, d))[:k]
        vals, counts = np.unique(labels[order], return_counts=True)
        out[ids[i]] = vals[counts == counts.max()].min()
    return out


@pytest.mark.parametrize("pivots,block", [(1, 20_000), (8, 40)])
def test_leave_one_out_equals_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(K, "BLOCK_ROWS", block)
    e = load_table(spark, SF_SMALL, "embeddings")
    rows = e.orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in rows])
    vecs = np.array([r["embedding"] for r in rows], dtype=np.float64)
    labels = np.array([r["label"] for r in rows])
    expect = brute(ids, vecs, labels, 5)
    got = {r["vec_id"]: r["prediction"] for r in K.knn_leave_one_out(
        e, id_col="vec_id", vec_col="embedding", label_col="label", k=5, n_pivots=pivots).collect()}
    assert got == expect


def test_regression_and_distance_weights(spark):
    rng = np.random.default_rng(3)
    n = 300
    vecs = rng.normal(size=(n, 8))
    target = vecs[:, 0] * 3 + rng.normal(size=n) * 0.1
    rows = [(int(i), [float(x) for x in vecs[i]], float(target[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y double")
    ids = np.arange(n)
    for weights in ("uniform", "distance"):
        got = {r["id"]: r["prediction"] for r in K.knn_leave_one_out(
            df, id_col="id", vec_col="v", label_col="y", k=4, problem_type="regression", weights=weights,
            n_pivots=4).collect()}
        for i in range(0, n, 37):
            d = ((vecs - vecs[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            nn = np.lexsort((ids, d))[:4]
            if weights == "uniform":
                expect = target[nn].mean()
            else:
                w = 1.0 / np.maximum(np.sqrt(d[nn]), 1e-12)
                expect = (w * target[nn]).sum() / w.sum()
            assert got[i] == pytest.approx(expect, rel=1e-9)


def plain(qids, qv, tid, tv, k, exclude_self, bound=None):
    d2 = np.zeros((len(qv), len(tv)))
    for j in range(qv.shape[1]):
        d2 += (qv[:, j][:, None] - tv[:, j]) ** 2
    out = []
    for i in range(len(qv)):
        near = [(d2[i, t], tid[t]) for t in range(len(tv)) if not (exclude_self and tid[t] == qids[i]) and (bound is None or d2[i, t] <= bound[i])]
        out += [(int(qids[i]), int(t), float(d)) for d, t in sorted(near)[:k]]
    return sorted(out)


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("dimensions", [3, 40])
def test_a_block_gives_what_all_pairs_give(monkeypatch, dimensions, exclude_self):
    """Lattice points: ties, equal vectors, repeated ids, bounds."""
    monkeypatch.setattr(K, "LEAF_ROWS", 8)
    monkeypatch.setattr(K, "QUERY_CHUNK", 1000)
    rng = np.random.default_rng(dimensions)
    tv, qv = (rng.integers(0, 4, (n, dimensions)) * (np.arange(dimensions) < 4) * 1.0 for n in (500, 120))
    tid, qids = rng.permutation(500) // 2, np.arange(120)
    lab = tid % 3
    found = lambda bound: sorted(K.block_topk(qv, qids, bound, tv, tid, lab, 5, exclude_self)[["qid", "tid", "d2"]].itertuples(index=False, name=None))
    assert found(np.full(120, np.inf)) == plain(qids, qv, tid, tv, 5, exclude_self)
    bound = rng.integers(0, 3, 120).astype(float)
    held = found(bound)
    assert set(plain(qids, qv, tid, tv, 5, exclude_self, bound)) <= set(held)


def test_equal_vectors_are_searched_once(monkeypatch):
    """A block of few distinct vectors costs its distinct pairs, not all of them."""
    met = []
    search = K.search_block
    monkeypatch.setattr(K, "search_block", lambda qv, bound, tv, *rest: met.append(len(qv) * len(tv)) or search(qv, bound, tv, *rest))
    kinds = np.random.default_rng(1).normal(size=(6, 3))
    tv, qv = kinds[np.arange(3000) % 6], kinds[np.arange(2000) % 6]
    out = K.block_topk(qv, np.arange(2000), np.full(2000, np.inf), tv, np.arange(3000), np.zeros(3000), 4, False)
    assert sum(met) <= 6 * 6 * 4 and len(out) == 8000
    assert out[out["qid"] == 7]["tid"].tolist() == [1, 7, 13, 19] and (out["d2"] == 0).all()


def test_a_bound_leaves_most_cells_out():
    """With the distance that its own cell gives, a query meets few of the other cells."""
    x = np.random.default_rng(4).normal(size=(20_000, 4))
    tree = K.CellTree.of(x, 1, 1, 100)
    cell = tree.cell(x)
    names, place, n = np.unique(cell, return_inverse=True, return_counts=True)
    assert len(names) == 100 and n.max() < 4 * n.min()
    boxes = K.Boxes(names, n, np.ones(100, int), *[np.stack([f(x[place == i], axis=0) for i in range(100)]) for f in (np.min, np.max)])
    q = x[:200]
    at, home, _ = boxes.routes(q, 5, None)
    assert at.tolist() == list(range(200)) and (home == cell[:200]).all()
    near = [K.search_block(q[i:i + 1], np.array([np.inf]), x[cell == home[i]], np.flatnonzero(cell == home[i]), 5) for i in range(200)]
    bound = np.array([d2[-1] for _, _, d2 in near])
    at, other, _ = boxes.routes(q, 5, bound)
    assert len(at) < 200 * 15
    for i in range(0, 200, 20):
        best = np.argsort(((x - q[i]) ** 2).sum(axis=1), kind="stable")[:5]
        assert set(cell[best]) <= {home[i], *other[at == i]}


def test_partitions_without_rows(spark):
    rng = np.random.default_rng(11)
    vecs, labels = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(vecs, labels))], "id long, v array<double>, y int")
    some = df.repartition(3).union(df.where("id < 0"))
    assert 0 in some.rdd.glom().map(len).collect()
    got = {r["id"]: r["prediction"] for r in K.knn_leave_one_out(some, id_col="id", vec_col="v", label_col="y", k=5, n_pivots=4).collect()}
    assert got == brute(np.arange(40), vecs, labels, 5)


def test_rows_without_a_vector_rank_last_by_id(spark):
    """As SQL has it: their distances are unknown and come behind all others; a null label loses a tie."""
    rows = [(1, None, 7), (2, [0.0, 0.0], 1), (3, [0.1, 0.0], 2), (4, [5.0, 5.0], None), (5, [None, 1.0], 3)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    near = K.knn_neighbours(df, df.select("id", "v"), id_col="id", vec_col="v", label_col="y", k=3, exclude_self=True).collect()
    got = {i: [(r["tid"], r["d2"] is None) for r in sorted((r for r in near if r["qid"] == i), key=lambda r: r["rn"])] for i in range(1, 6)}
    assert got == {1: [(2, True), (3, True), (4, True)], 2: [(3, False), (4, False), (1, True)], 3: [(2, False), (4, False), (1, True)],
                   4: [(3, False), (2, False), (1, True)], 5: [(1, True), (2, True), (3, True)]}
    votes = {r["id"]: r["prediction"] for r in K.knn_leave_one_out(df, id_col="id", vec_col="v", label_col="y", k=2).collect()}
    assert votes == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
