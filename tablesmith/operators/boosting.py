"""Gradient-boosted trees of many configurations and folds in shared passes.

Boosting is a chain of tree levels, each a pass over the rows. Cross-validation and tuning ask for dozens of such chains over
the same rows, so they advance together: one pass adds up, for every fit and every open node of its present tree, the
gradients and Hessians by feature bin; Spark adds the tasks' sums by (fit, node) and picks the best split of each node; the
driver sees one row per node. A fit leaves out its fold, but scores its rows all the same, so the out-of-fold
predictions of all fits are there when the last tree is done.

Features are cut into bins by a rank sketch. The binned rows are stored in blocks with the raw scores (margins) of all
fits, which are written anew every ``REFRESH`` trees: a pass adds at most so many trees to the stored margins, and
a lost executor costs its blocks' share of one pass. A table that is one block (its size is checked) needs no sums
across tasks: there every fit is one task that runs its chain on the broadcast block, by the same steps.

Rows of equal codes have equal margins, so a chain only needs their number and the sum of their labels, for each tree those of
the rows it samples. A table of few features has far fewer such cells than rows. A task that holds all rows grows its
chain on their cells; over many blocks, where the cells are few (they are counted first), one pass adds up the cells, another what each
tree samples of them, and again every fit is one task.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.operators.quantiles import GRID, sketch_ranks
from tablesmith.session import cut_lineage

#: Bins of a feature, rows and bytes of codes of a block, trees between two writes of the margins.
BINS, BLOCK_ROWS, BLOCK_BYTES, REFRESH = 64, 65_536, 32 << 20, 8
#: Bytes of codes up to which a table is a single block, and rows of one numpy step.
SINGLE_BYTES, STEP_ROWS = 8 << 20, 65_536
#: Bytes of histograms that a task adds up at once; more fits than that take turns.
HISTOGRAM_BYTES = 128 << 20
#: Cells (codes, fold and class) of a table whose chains run on cells, bytes of their codes, and of what all trees sample of them.
CELLS, CELL_BYTES, SAMPLED_BYTES = 65_536, 8 << 20, 64 << 20
#: Cells that a block may have, however few rows it has; a larger one, as a table, has twice as many rows as cells.
BLOCK_CELLS = 4096
#: Partial sums of one node that meet in one task, in the first of two rounds.
SPREAD = 64
SEED = 42


@dataclass(frozen=True)
class Boost:
    """A configuration: trees, learning rate, depth, ridge on leaf values, least Hessian of a leaf, share of rows per tree."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 3
    ridge: float = 0.0
    least: float = 1e-3
    sample: float = 1.0


@dataclass(frozen=True)
class BoostFit:
    """One chain: its configuration, the fold it leaves out (None: none), the class it tells from the rest (None: numbers)."""

    config: Boost
    fold: int | None = None
    target: int | None = 1


@dataclass
class Tree:
    """A complete binary tree by level: feature (-1: leaf), bin (rows with a larger code go right) and value of each node."""

    depth: int
    feature: np.ndarray = None
    bin: np.ndarray = None
    value: np.ndarray = None

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        if self.feature is None:
            self.feature, self.bin, self.value = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size)

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row has reached."""
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = codes[rows, np.maximum(f, 0)] > self.bin[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def grow(self, node: int, split: tuple, config: Boost) -> list[int]:
        """Split ``node`` or leave it a leaf; the children that are still open. ``split``: (feature, bin, gain, left gradient, left
        Hessian, gradient, Hessian)."""
        f, b, gain, gl, hl, g, h = split
        leaf = lambda g, h: -config.rate * g / (h + config.ridge + 1e-12)
        self.value[node] = leaf(g, h)
        if not gain > 1e-12:
            return []
        self.feature[node], self.bin[node] = int(f), int(b)
        left, right = 2 * node + 1, 2 * node + 2
        self.value[left], self.value[right] = leaf(gl, hl), leaf(g - gl, h - hl)
        return [left, right]


def slopes(margin: np.ndarray, y: np.ndarray, target: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss: logistic for a class, squared for a number."""
    if target is None:
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    return p - (y == target), np.maximum(p * (1 - p), 1e-16)


def cell_slopes(margin: np.ndarray, n: np.ndarray, s: np.ndarray, target: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradient and Hessian of ``n`` rows of one margin, whose labels sum to ``s``."""
    if target is None:
        return n * margin - s, n
    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    return n * p - s, n * np.maximum(p * (1 - p), 1e-16)


def histograms(codes: np.ndarray, node: np.ndarray, open_: list[int], keep: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of gradient and Hessian per open node and (feature, bin): ``(nodes, 2, features * BINS)``."""
    d = codes.shape[1]
    width, offset = d * BINS, np.arange(d) * BINS
    place = np.full(max(open_) + 1, -1, np.int64)
    place[open_] = np.arange(len(open_))
    rows = np.flatnonzero(keep & (node <= open_[-1]))
    rows = rows[place[node[rows]] >= 0]
    out = np.zeros((2, len(open_) * width))
    for s in range(0, len(rows), STEP_ROWS):
        step = rows[s:s + STEP_ROWS]
        at = (codes[step] + (offset + place[node[step]][:, None] * width)).ravel()
        for v, total in zip((g, h), out):
            total += np.bincount(at, np.repeat(v[step], d), len(total))
    return out.reshape(2, len(open_), width).swapaxes(0, 1)


def best_split(hist: np.ndarray, d: int, config: Boost) -> tuple:
    """The split of one node with the largest gain, the first of equals; ``hist``: ``(2, d * BINS)``."""
    sums = np.cumsum(hist.reshape(2, d, BINS), axis=2)
    g, h = sums[0, 0, -1], sums[1, 0, -1]
    gl, hl = sums[0, :, :-1], sums[1, :, :-1]
    gr, hr = g - gl, h - hl
    score = lambda a, b: a * a / (b + config.ridge + 1e-12)
    gain = np.where((hl >= config.least) & (hr >= config.least), score(gl, hl) + score(gr, hr) - score(g, h), -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, BINS - 1)
    return f, b, float(gain[f, b]), float(gl[f, b]), float(hl[f, b]), float(g), float(h)


def cells_of(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Place of one row of each distinct row of codes, and the distinct one of each row; None if there are more than ``most``."""
    key, size = np.zeros(len(codes), np.int64), 1
    for column in codes.T:
        if size > (1 << 62) // BINS:
            known, key = np.unique(key, return_inverse=True)
            size = len(known)
            if size > most:
                return None
        key, size = key * BINS + column, size * BINS
    known, first, which = np.unique(key, return_index=True, return_inverse=True)
    return (first, which.ravel()) if len(known) <= most else None


def sampled(config: Boost, tree: int, block: int, rows: int) -> np.ndarray | bool:
    """Which rows of a block the tree sees; the same whenever it is asked."""
    return True if config.sample >= 1 else np.random.default_rng([SEED, tree, block]).random(rows) < config.sample


# ---------------------------------------------------------------------------------------------------------------
# Blocks of binned rows
# ---------------------------------------------------------------------------------------------------------------


@dataclass
class Blocks:
    """Binned rows: ``df`` (block, codes, y, fold), one row per block; the bins' edges; rows and labels per fold."""

    df: DataFrame
    edges: list[np.ndarray]
    rows: int
    counts: dict          # (fold, class) -> rows, or (fold, None) -> (rows, sum) for numbers
    single: tuple | None  # the only block's arrays, where there is no other


_making = threading.Lock()


def blocks_of(df: DataFrame, n_features: int, numbers: bool, cache: dict | None = None) -> Blocks:
    """Cut the features into bins and store the rows in blocks; kept in ``cache`` for later calls."""
    with _making:
        if cache is None or "blocks" not in cache:
            made = _make_blocks(df, n_features, numbers)
            if cache is None:
                return made
            cache["blocks"] = made
        return cache["blocks"]


def _make_blocks(df: DataFrame, d: int, numbers: bool) -> Blocks:
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(-1)
    slim = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), fold.alias("fold"))
    sketch = sketch_ranks(slim, {str(i): F.col("x")[i] for i in range(d)})
    edges = []
    for i in range(d):
        c = sketch.columns[str(i)]
        step = -(-GRID // (BINS - 2))
        values = sorted({*c.grid, c.low}) if c.n else []
        if len(values) >= BINS:
            values = sorted({c.low, *c.grid[::step]})
        edges.append(np.array([v for v in values if v != c.high], np.float64))
    size, alone = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(d, 1))), sketch.rows * max(d, 1) <= SINGLE_BYTES
    if alone:
        size, dealt = max(1, sketch.rows), slim.coalesce(1)
    else:
        dealt = slim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def emit(parts: list[tuple]) -> pa.RecordBatch:
            codes, y, f = (np.concatenate(p) for p in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()),
                                               pa.array([f.tobytes()], pa.binary())], ["codes", "y", "fold"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
                codes = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                held.append((codes, part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False).astype(np.int32)))
                if sum(len(h[1]) for h in held) >= size:
                    yield emit(held)
                    held.clear()
        if held:
            yield emit(held)

    stored = cut_lineage(dealt.mapInArrow(run, "codes binary, y binary, fold binary").withColumn("block", F.monotonically_increasing_id()))
    if numbers:
        found = slim.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()
        counts = {(r["fold"], None): (r["n"], r["s"]) for r in found}
    else:
        counts = {(r["fold"], int(r["y"])): r["n"] for r in slim.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    single = None
    if alone:
        rows = stored.collect()  # one row, or none of an empty table
        single = (rows[0]["codes"], rows[0]["y"], rows[0]["fold"]) if rows else (b"", b"", b"")
    return Blocks(stored, edges, sketch.rows, counts, single)


def _arrays(codes: bytes, y: bytes, fold: bytes, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(codes, np.uint8).reshape(-1, d), np.frombuffer(y, np.float64), np.frombuffer(fold, np.int32)


def _start(blocks: Blocks, fit: BoostFit) -> float:
    """The first margin: log-odds of the class among the rows of the fit, or the mean."""
    kept = {k: v for k, v in blocks.counts.items() if k[0] != fit.fold}
    if fit.target is None:
        n, s = sum(v[0] for v in kept.values()), sum(v[1] for v in kept.values())
        return s / n if n else 0.0
    n, hits = sum(kept.values()), sum(v for k, v in kept.items() if k[1] == fit.target)
    share = min(max(hits / n, 1e-6), 1 - 1e-6) if n else 0.5
    return float(np.log(share / (1 - share)))


# ---------------------------------------------------------------------------------------------------------------
# Fits
# ---------------------------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Fits with their trees, and the margins: rows ``(fits, y, fold, margins)`` with a column of margins for each of their fits."""

    fits: list[BoostFit]
    trees: list[list[Tree]]
    starts: list[float]
    margins: DataFrame
    edges: list[np.ndarray] = field(default_factory=list)


def boost(blocks: Blocks, fits: list[BoostFit]) -> Boosted:
    """Run all chains."""
    starts = [_start(blocks, f) for f in fits]
    if blocks.single:
        return _boost_in_tasks(blocks, fits, starts)
    cells = _table_cells(blocks, fits)
    return _boost_in_passes(blocks, fits, starts) if cells is None else _boost_on_cells(blocks, fits, starts, cells)


def grow_on(codes: np.ndarray, fit: BoostFit, start: float, weights: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> tuple[list[Tree], np.ndarray]:
    """One fit over cells of rows with equal codes: its trees, and the margin of each cell. ``weights(t)``: of the rows of each cell that tree ``t``
    sees, how many there are and the sum of their labels (of a class: how many are of it)."""
    d = codes.shape[1]
    margin, trees, config = np.full(len(codes), start), [], fit.config
    for t in range(config.rounds):
        n, s = weights(t)
        g, h = cell_slopes(margin, n, s, fit.target)
        keep = n > 0
        tree, open_ = Tree(config.depth), [0]
        for _ in range(config.depth):
            hist = histograms(codes, tree.nodes(codes), open_, keep, g, h)
            open_ = [child for node, x in zip(open_, hist) for child in tree.grow(node, best_split(x, d, config), config)]
            if not open_:
                break
        trees.append(tree)
        margin = margin + tree.value[tree.nodes(codes)]
    return trees, margin


def grow_chain(codes: np.ndarray, y: np.ndarray, fold: np.ndarray, fit: BoostFit, start: float,
               cells: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[Tree], np.ndarray]:
    """One fit over a block that is the whole table: its trees, and the margins of all rows. ``cells``: the rows' cells, where they are worth it."""
    config = fit.config
    train = fold != fit.fold if fit.fold is not None else np.ones(len(y), bool)
    label = y if fit.target is None else (y == fit.target).astype(np.float64)

    def weights(t: int) -> tuple[np.ndarray, np.ndarray]:
        keep = train & sampled(config, t, 0, len(y))
        if cells is None:
            return keep.astype(np.float64), np.where(keep, label, 0.0)
        which = cells[1][keep]
        return np.bincount(which, minlength=len(cells[0])).astype(np.float64), np.bincount(which, label[keep], len(cells[0]))

    if config.sample >= 1:  # every tree sees the same rows
        whole = weights(0)
        trees, margin = grow_on(codes if cells is None else codes[cells[0]], fit, start, lambda t: whole)
    else:
        trees, margin = grow_on(codes if cells is None else codes[cells[0]], fit, start, weights)
    return trees, margin if cells is None else margin[cells[1]]


def _boost_in_tasks(blocks: Blocks, fits: list[BoostFit], starts: list[float]) -> Boosted:
    """One task per model (configuration and fold) on the broadcast block, which has at most ``SINGLE_BYTES`` of codes. A model
    that leaves a fold out gives the margins of that fold, one of all rows gives its trees."""
    spark, d = blocks.df.sparkSession, len(blocks.edges)
    block = spark.sparkContext.broadcast(blocks.single)
    models: dict[tuple, list[int]] = {}
    for i, f in enumerate(fits):
        models.setdefault((f.config, f.fold), []).append(i)
    # the costliest models first
    units = sorted(models.values(), key=lambda members: -fits[members[0]].config.rounds * fits[members[0]].config.depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y, fold = _arrays(*block.value, d)
        cells = cells_of(codes, len(y) // 2)
        for batch in batches:
            for u in batch.column(0).to_pylist():
                grown = [grow_chain(codes, y, fold, fits[i], starts[i], cells) for i in units[u]]
                out = fits[units[u][0]].fold
                mine = fold == out if out is not None else np.zeros(len(y), bool)
                table = np.stack([m[mine] for _, m in grown], axis=1)
                kept = [[t for trees, _ in grown for t in trees]] if out is None else [[]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([units[u]], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in (y[mine], fold[mine], table)],
                     *[pa.array([b"".join(getattr(t, part).tobytes() for t in trees)], pa.binary()) for trees in kept for part in ("feature", "bin", "value")]],
                    ["fits", "y", "fold", "margins", "feature", "bin", "value"])

    ids = spark.range(0, len(units), 1, len(units))
    done = cut_lineage(ids.mapInArrow(run, "fits array<long>, y binary, fold binary, margins binary, feature binary, bin binary, value binary"))
    trees: list[list[Tree]] = [[] for _ in fits]
    if any(f.fold is None for f in fits):
        for r in done.where(F.length("value") > 0).select("fits", "feature", "bin", "value").collect():
            config = fits[r["fits"][0]].config
            parts = [np.frombuffer(r[c], kind).reshape(len(r["fits"]), config.rounds, -1) for c, kind in (("feature", np.int32), ("bin", np.int32), ("value", np.float64))]
            for i, *of_fit in zip(r["fits"], *parts):
                trees[i] = [Tree(config.depth, *x) for x in zip(*of_fit)]
    return Boosted(fits, trees, starts, done.select("fits", "y", "fold", "margins"), blocks.edges)


@dataclass
class Cells:
    """The cells of a table, by codes, fold and class (0 of numbers): codes, the distinct codes that each cell has, fold, class, rows, sum of labels."""

    codes: np.ndarray
    code: np.ndarray
    fold: np.ndarray
    y: np.ndarray
    n: np.ndarray
    s: np.ndarray

    def places(self) -> dict[tuple, int]:
        """The place of a cell by its codes, fold and class."""
        return {(self.codes[c].tobytes(), f, y): i for i, (c, f, y) in enumerate(zip(self.code.tolist(), self.fold.tolist(), self.y.tolist()))}

    def weights(self, fit: BoostFit, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per distinct codes, the rows that the fit learns from and the sum of their labels, from those of each cell."""
        kept = self.fold != fit.fold if fit.fold is not None else np.ones(len(self.fold), bool)
        label = s if fit.target is None else n * (self.y == fit.target)
        return np.bincount(self.code, n * kept, len(self.codes)), np.bincount(self.code, label * kept, len(self.codes))


def _block_cells(codes: np.ndarray, y: np.ndarray, fold: np.ndarray, numbers: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """``cells_of`` a block's rows by codes, fold and class; None if there are too many."""
    most = min(CELLS, CELL_BYTES // max(1, codes.shape[1]), max(BLOCK_CELLS, len(codes) // 2))
    found = cells_of(codes, most)
    if found is None:
        return None
    key = np.stack([found[1], fold, np.zeros(len(y)) if numbers else y], axis=1)
    _, first, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
    return (first, which.ravel()) if len(first) <= most else None


def _table_cells(blocks: Blocks, fits: list[BoostFit]) -> Cells | None:
    """The cells of all blocks; None if they are too many for a broadcast, or more than half the rows."""
    d, numbers = len(blocks.edges), fits[0].target is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, y, fold in zip(*[c.to_pylist() for c in batch.columns]):
                codes, y, fold = _arrays(codes, y, fold, d)
                found = _block_cells(codes, y, fold, numbers)
                if found is None:  # a row without codes says that there are too many
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([0], pa.int32()), pa.array([0.0]), pa.array([0], pa.int64()),
                                                      pa.array([0.0])], ["codes", "fold", "y", "n", "s"])
                    continue
                first, which = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array([codes[i].tobytes() for i in first], pa.binary()), pa.array(fold[first]), pa.array(np.zeros(len(first)) if numbers else y[first]),
                     pa.array(np.bincount(which, minlength=len(first))), pa.array(np.bincount(which, y, len(first)))], ["codes", "fold", "y", "n", "s"])

    parts = blocks.df.select("codes", "y", "fold").mapInArrow(run, "codes binary, fold int, y double, n long, s double")
    most = min(CELLS, CELL_BYTES // max(1, d), blocks.rows // 2)
    found = parts.groupBy("codes", "fold", "y").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).limit(most + 1).toArrow()
    rounds = max((f.config.rounds for f in fits if f.config.sample < 1), default=0)
    if len(found) > most or len(found) * rounds * 16 > SAMPLED_BYTES or found.column("codes").null_count:
        return None
    found = found.sort_by([(c, "ascending") for c in ("codes", "fold", "y")])
    names = found.column("codes").to_pylist()
    known = {c: i for i, c in enumerate(dict.fromkeys(names))}
    return Cells(np.frombuffer(b"".join(known), np.uint8).reshape(-1, d), np.array([known[c] for c in names], np.int64),
                 *[found.column(c).to_numpy() for c in ("fold", "y")], *[found.column(c).to_numpy().astype(np.float64) for c in ("n", "s")])


def _sampled_cells(blocks: Blocks, cells: Cells, config: Boost, rounds: int, numbers: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per tree, the rows of each cell that it samples and the sum of their labels, added up in one pass over the blocks."""
    d, size = len(blocks.edges), len(cells.n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places = np.zeros((rounds, 2, size)), cells.places()
        for batch in batches:
            for codes, y, fold, block in zip(*[c.to_pylist() for c in batch.columns]):
                codes, y, fold = _arrays(codes, y, fold, d)
                first, which = _block_cells(codes, y, fold, numbers)
                at = np.array([places[codes[i].tobytes(), int(fold[i]), 0.0 if numbers else float(y[i])] for i in first], np.int64)
                for t in range(rounds):
                    keep = sampled(config, t, block, len(y))
                    total[t, 0, at] += np.bincount(which[keep], minlength=len(first))
                    total[t, 1, at] += np.bincount(which[keep], y[keep], len(first))
        for t in range(rounds):
            yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([total[t].ravel()], pa.list_(pa.float64()))], ["tree", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            total = total + batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total], pa.list_(pa.float64()))], ["tree", "sums"])

    parts = blocks.df.select("codes", "y", "fold", "block").mapInArrow(run, "tree long, sums array<double>")
    found = parts.groupBy("tree").applyInArrow(add, "tree long, sums array<double>").toArrow().sort_by("tree")
    return list(found.column("sums").combine_chunks().flatten().to_numpy().reshape(rounds, 2, size))


def _boost_on_cells(blocks: Blocks, fits: list[BoostFit], starts: list[float], cells: Cells) -> Boosted:
    """One task per fit on the broadcast cells, and per tree what it samples of them; one more pass gives every row the margins of its cell."""
    spark, d, k, numbers = blocks.df.sparkSession, len(blocks.edges), len(fits), fits[0].target is None
    # the draws depend on the share of rows and the tree alone
    draws = {share: _sampled_cells(blocks, cells, config, max(f.config.rounds for f in fits if f.config.sample == share), numbers)
             for share, config in {f.config.sample: f.config for f in fits if f.config.sample < 1}.items()}
    held = spark.sparkContext.broadcast((cells, draws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, draws = held.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                fit, whole = fits[i], cells.weights(fits[i], cells.n, cells.s)
                weights = lambda t: cells.weights(fit, *draws[fit.config.sample][t]) if fit.config.sample < 1 else whole  # noqa: B023, E731
                trees, margin = grow_on(cells.codes, fit, starts[i], weights)
                kept = trees if fit.fold is None else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([margin.tobytes()], pa.binary()), *[pa.array([b"".join(getattr(t, part).tobytes() for t in kept)], pa.binary())
                                                                               for part in ("feature", "bin", "value")]], ["fit", "margin", "feature", "bin", "value"])

    order = sorted(range(k), key=lambda i: -fits[i].config.rounds * fits[i].config.depth)  # the costliest fits first
    dealt = spark.sparkContext.parallelize([(i,) for i in order], k).toDF("fit long")
    margins, trees = np.zeros((len(cells.codes), k)), [[] for _ in fits]
    for r in dealt.mapInArrow(run, "fit long, margin binary, feature binary, bin binary, value binary").collect():
        margins[:, r["fit"]], config = np.frombuffer(r["margin"], np.float64), fits[r["fit"]].config
        if r["value"]:
            parts = [np.frombuffer(r[c], kind).reshape(config.rounds, -1) for c, kind in (("feature", np.int32), ("bin", np.int32), ("value", np.float64))]
            trees[r["fit"]] = [Tree(config.depth, *x) for x in zip(*parts)]
    told = spark.sparkContext.broadcast(({c.tobytes(): i for i, c in enumerate(cells.codes)}, margins))

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, margins = told.value
        for batch in batches:
            out = []
            for codes in batch.column("codes").to_pylist():
                codes = np.frombuffer(codes, np.uint8).reshape(-1, d)
                first, which = cells_of(codes, len(codes))
                out.append(margins[np.array([place[codes[i].tobytes()] for i in first], np.int64)][which].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), pa.array(out, pa.binary())], ["y", "fold", "margins"])

    every = F.array(*[F.lit(i).cast("long") for i in range(k)])
    table = blocks.df.select("codes", "y", "fold").mapInArrow(give, "y binary, fold binary, margins binary")
    return Boosted(fits, trees, starts, table.select(every.alias("fits"), "y", "fold", "margins"), blocks.edges)


def _boost_in_passes(blocks: Blocks, fits: list[BoostFit], starts: list[float]) -> Boosted:
    """All chains in lockstep over the stored blocks."""
    d, k = len(blocks.edges), len(fits)
    trees: list[list[Tree]] = [[] for _ in fits]
    begin = np.array(starts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [len(v) // 8 for v in batch.column("y").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.tile(begin, (n, 1)).tobytes() for n in rows], pa.binary())],
                                             [*batch.schema.names, "margins"])

    schema = "codes binary, y binary, fold binary, block long, margins binary"
    table = cut_lineage(blocks.df.select("codes", "y", "fold", "block").mapInArrow(first, schema))
    written, many = 0, blocks.df.rdd.getNumPartitions() > SPREAD
    for t in range(max(f.config.rounds for f in fits)):
        now = [i for i in range(k) if t < fits[i].config.rounds]
        grown = {i: Tree(fits[i].config.depth) for i in now}
        open_ = {i: [0] for i in now}
        while open_:
            splits: dict[int, dict[int, tuple]] = {}
            for group in _turns(open_, d):
                splits |= _pass(table, fits, {i: trees[i][written:] for i in group}, {i: grown[i] for i in group}, {i: open_[i] for i in group}, t, d, many)
            after = {}
            for i, nodes in open_.items():
                children = [c for node in nodes for c in (grown[i].grow(node, splits[i][node], fits[i].config) if node in splits.get(i, {}) else [])]
                if children and children[0] < 2 ** fits[i].config.depth - 1:  # children on the last level are leaves
                    after[i] = children
            open_ = after
        for i in now:
            trees[i].append(grown[i])
        if (t + 1) % REFRESH == 0:
            table, written = cut_lineage(_add_trees(table, {i: trees[i][written:] for i in range(k)}, d, k, schema)), t + 1
    table = cut_lineage(_add_trees(table, {i: trees[i][written:] for i in range(k)}, d, k, schema))
    every = F.array(*[F.lit(i).cast("long") for i in range(k)])
    return Boosted(fits, trees, starts, table.select(every.alias("fits"), "y", "fold", "margins"), blocks.edges)


def _turns(open_: dict[int, list[int]], d: int) -> Iterator[list[int]]:
    """Fits whose histograms a task can hold together."""
    group, held = [], 0
    for i, nodes in open_.items():
        size = len(nodes) * d * BINS * 16
        if group and held + size > HISTOGRAM_BYTES:
            yield group
            group, held = [], 0
        group.append(i)
        held += size
    if group:
        yield group


def _with_trees(margin: np.ndarray, codes: np.ndarray, trees: list[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.nodes(codes)]
    return margin


def _add_trees(table: DataFrame, trees: dict[int, list[Tree]], d: int, k: int, schema: str) -> DataFrame:
    """The blocks with margins that include ``trees``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, y, fold, _, margins in zip(*[c.to_pylist() for c in batch.columns]):
                codes = np.frombuffer(codes, np.uint8).reshape(-1, d)
                old = np.frombuffer(margins, np.float64).reshape(-1, k)
                out.append(np.stack([_with_trees(old[:, i], codes, trees[i]) for i in range(k)], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], batch.schema.names)

    return table.mapInArrow(run, schema)


def _pass(table: DataFrame, fits: list[BoostFit], later: dict[int, list[Tree]], grown: dict[int, Tree], open_: dict[int, list[int]], t: int,
          d: int, many: bool) -> dict[int, dict[int, tuple]]:
    """Best split of every open node of the given fits: ``{fit: {node: split}}``."""
    k, width, configs = len(fits), d * BINS, {i: fits[i].config for i in open_}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        part = 0
        for batch in batches:
            for codes, y, fold, block, margins in zip(*[c.to_pylist() for c in batch.columns]):
                codes, y, fold = _arrays(codes, y, fold, d)
                old, part = np.frombuffer(margins, np.float64).reshape(-1, k), block
                for i in open_:
                    g, h = slopes(_with_trees(old[:, i], codes, later[i]), y, fits[i].target)
                    keep = sampled(configs[i], t, block, len(y)) & (fold != fits[i].fold if fits[i].fold is not None else np.ones(len(y), bool))
                    hist = histograms(codes, grown[i].nodes(codes), open_[i], keep, g, h)
                    sums[i] = sums[i] + hist if i in sums else hist
        for i, hist in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hist), i)), pa.array(open_[i]), pa.array(np.full(len(hist), part % SPREAD)),
                                              pa.array(list(hist.reshape(len(hist), -1)), pa.list_(pa.float64()))], ["fit", "node", "part", "hist"])

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = 0.0
        for batch in batches:
            total = total + batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).sum(axis=0)
        return total

    def one_row(key: tuple, numbers: np.ndarray, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([numbers], pa.list_(pa.float64()))], ["fit", "node", name])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield one_row(key, add(batches), "hist")

    def choose(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield one_row(key, np.array(best_split(add(batches).reshape(2, width), d, configs[key[0].as_py()]), np.float64), "split")

    parts = table.mapInArrow(run, "fit long, node long, part long, hist array<double>")
    # the sums of many tasks meet in two rounds, those of a few in one
    merged = parts.groupBy("fit", "node", "part").applyInArrow(merge, "fit long, node long, hist array<double>") if many else parts.drop("part")
    found: dict[int, dict[int, tuple]] = {}
    for r in merged.groupBy("fit", "node").applyInArrow(choose, "fit long, node long, split array<double>").collect():
        found.setdefault(r["fit"], {})[r["node"]] = tuple(r["split"])
    return found


# ---------------------------------------------------------------------------------------------------------------
# Predictions and models
# ---------------------------------------------------------------------------------------------------------------


def out_of_fold(boosted: Boosted, names: list[str]) -> DataFrame:
    """Predictions of each row by the fits that left its fold out: ``(model_id, fold, label, prediction, n)``. Fits of one name and
    fold are the classes of one model (the largest margin wins); of classes only counts leave a task."""
    fits = boosted.fits
    groups: dict[tuple, list[int]] = {}
    for i, (name, fit) in enumerate(zip(names, fits)):
        if fit.fold is not None:
            groups.setdefault((name, fit.fold), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, y, fold, margins in zip(*[c.to_pylist() for c in batch.columns]):
                y, fold = np.frombuffer(y, np.float64), np.frombuffer(fold, np.int32)
                table, column = np.frombuffer(margins, np.float64).reshape(len(y), len(held)), {i: c for c, i in enumerate(held)}
                for (name, out), members in groups.items():
                    if members[0] not in column:
                        continue
                    mine = fold == out
                    label, guess = y[mine], class_of(table[mine][:, [column[i] for i in members]], fits[members[0]].target is None)
                    n = np.ones(len(label), np.int64)
                    if fits[members[0]].target is not None and len(label):
                        (label, guess), n = np.unique(np.stack([label, guess]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(np.full(len(n), out, np.int32)),
                                                      pa.array(label), pa.array(guess), pa.array(n.astype(np.int64))],
                                                     ["model_id", "fold", "label", "prediction", "n"])

    return boosted.margins.select("fits", "y", "fold", "margins").mapInArrow(run, "model_id string, fold int, label double, prediction double, n long")


def class_of(margins: np.ndarray, numbers: bool) -> np.ndarray:
    """The number itself; of two classes the sign; of more the largest margin."""
    if numbers:
        return margins[:, 0]
    return (margins[:, 0] > 0).astype(np.float64) if margins.shape[1] == 1 else margins.argmax(axis=1).astype(np.float64)


@dataclass
class BoostedModel:
    """A model for scoring: per class a start and trees with thresholds on the features themselves."""

    numbers: bool
    depth: int
    starts: list[float]
    chains: list[list[dict]]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "BoostedModel":
        return cls(**json.loads(text))

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.starts), (len(x), 1))
        rows = np.arange(len(x))
        for i, chain in enumerate(self.chains):
            for tree in chain:
                feature, threshold, value = (np.asarray(tree[c]) for c in ("feature", "threshold", "value"))
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    f = feature[node]
                    node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node]), node)
                out[:, i] += value[node]
        return out

    def predict(self, features: Column) -> Column:
        """The prediction of an ``array<double>`` of features (class code or number)."""
        model = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(class_of(model.margins(np.stack(x.to_list()).astype(np.float64)), model.numbers))

        return score(features)


def targets_of(n_classes: int, numbers: bool) -> list[int | None]:
    """The chains of a model: one for numbers and for two classes, else one per class."""
    return [None] if numbers else [1] if n_classes <= 2 else list(range(n_classes))


def fit_model(df: DataFrame, n_features: int, config: Boost, n_classes: int, numbers: bool, cache: dict | None = None) -> BoostedModel:
    """A model of all rows of ``df`` (``features``, ``label``)."""
    blocks = blocks_of(df, n_features, numbers, cache)
    done = boost(blocks, [BoostFit(config, None, c) for c in targets_of(n_classes, numbers)])
    chains = []
    for trees in done.trees:
        chains.append([{"feature": t.feature.tolist(), "value": t.value.tolist(),
                        "threshold": [float(blocks.edges[f][b]) if f >= 0 else 0.0 for f, b in zip(t.feature.tolist(), t.bin.tolist())]} for t in trees])
    return BoostedModel(numbers, config.depth, done.starts, chains)
