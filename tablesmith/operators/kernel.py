"""Kernel slots (M6, M7): a margin learner on random Fourier features of an RBF kernel, fitted in shared passes.

``WIDTH`` random features of a row take 2 KB, a hundred times the row itself on narrow tables, so they are never stored: every pass draws
them anew from the features inside its tasks. A pass adds up loss, gradient and Hessian of all fits (configuration,
held-out fold, class); the driver takes one Newton step per fit, so some twenty passes are enough where a first-order
method needs over a hundred. Spark adds the tasks' sums in chunks, so no task holds more than ``CHUNK`` numbers of each.

Losses: hinge (``mean(hinge) + penalty / 2 |w|^2``), smoothed around the margin by a width that shrinks to ``WIDTHS[-1]``, and Huber's with
its scale as one more unknown (``mean(s + H((y - score) / s) s) + penalty / 2 |w * spread|^2``). Both start at the least-squares fit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Random features of the kernel. The error of a kernel value falls with their root.
WIDTH = 256
#: Half widths of the band in which the hinge is a parabola, one after the other; Huber's border in units of the scale.
WIDTHS, EPSILON = (1.0, 0.25, 0.0625, 0.015), 1.35
#: Shorter steps whose loss a pass adds up as well, for when the whole step does not lower it.
SHORTER = (0.5, 0.25, 0.1, 0.03)
#: Passes of a fit at most; a band is done when a step would lower the loss by less than this share (the last one: the second).
MOST_STEPS, ROUGH, FINE = 60, 2e-3, 2e-5
#: Share of the mean curvature added to the system: above the rounding of its single-precision products.
DAMPING = 1e-6
#: Rows of one numpy step, fits that advance together, numbers of a sum that meet in one task.
STEP_ROWS, TURN, CHUNK = 4096, 64, 4096


@dataclass(frozen=True)
class FourierMap:
    """``sqrt(2 / width) * cos(x W + b)``, whose inner products approach ``exp(-gamma |x - y|^2)``; drawn from its seed, so a bundle
    keeps four numbers."""

    gamma: float
    features: int
    width: int = WIDTH
    seed: int = 42

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(size=(self.features, self.width)) * np.sqrt(2 * self.gamma), rng.uniform(0, 2 * np.pi, self.width)

    def image(self, x: np.ndarray) -> np.ndarray:
        """Random features of the rows in single precision; whole turns go in double precision first."""
        weights, shift = self.arrays()
        turns = x @ (weights / (2 * np.pi))
        turns += shift / (2 * np.pi)
        turns -= np.rint(turns)
        out = turns.astype(np.float32)
        out *= np.float32(2 * np.pi)
        np.cos(out, out=out)
        out *= np.float32(np.sqrt(2 / self.width))
        return out

    def lift(self, df: DataFrame, col: str = "features") -> DataFrame:
        """``df`` with the vector column replaced by its random features, in Arrow batches."""
        me = self

        @F.pandas_udf("array<double>")
        def image(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(me.image(np.stack(x.to_list()).astype(np.float64)).astype(np.float64)))

        return df.withColumn(col, array_to_vector(image(vector_to_array(col))))


def _gamma(setting: str | float, features: int, rows: float, total: float, squares: float) -> float:
    if not isinstance(setting, str):
        return float(setting)
    if setting == "auto":
        return 1.0 / max(1, features)
    if setting != "scale":
        raise ValueError(f"gamma is 'scale', 'auto' or a number, not {setting!r}")
    entries = max(1, features) * max(rows, 1.0)
    variance = squares / entries - (total / entries) ** 2
    return 1.0 / (max(1, features) * variance) if variance > 1e-12 else 1.0


def _entry_sums(df: DataFrame, col: str) -> list[Column]:
    x = vector_to_array(col)
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total(lambda v: v)), F.lit(0.0)).alias("s"),
            F.coalesce(F.sum(total(lambda v: v * v)), F.lit(0.0)).alias("q")]


def gamma_of(df: DataFrame, setting: str | float, features: int, col: str = "features") -> float:
    """``auto``: 1 / features; ``scale``: 1 / (features * variance of all entries); or the number itself."""
    if setting != "scale":
        return _gamma(setting, features, 0, 0, 0)
    return _gamma(setting, features, *df.agg(*_entry_sums(df, col)).first())


@dataclass(frozen=True)
class KernelSlot:
    """A configuration: ``hinge`` or ``huber``, kernel width, penalty on the squared weights."""

    loss: str
    penalty: float
    gamma: str | float = "scale"


@dataclass(frozen=True)
class KernelFit:
    """One fit: its configuration, the fold it leaves out (None: none), the class it tells from the rest (None: numbers)."""

    slot: KernelSlot
    fold: int | None = None
    target: int | None = 1


class _Search:
    """Newton's method of one fit, a step per pass: where to look next, and what is known of the best point so far."""

    def __init__(self, fit: KernelFit, width: int):
        self.fit, self.hinge = fit, fit.slot.loss == "hinge"
        self.now, self.scale = np.zeros(width + 1), 1.0
        self.stage, self.best, self.value, self.done, self.failed = -1, None, np.inf, False, 0
        self.step = None
        self.shape = np.append(np.ones(width), 0.0)

    def points(self) -> list[tuple]:
        """Where the next pass looks: weights and scale, and those of shorter steps."""
        if self.step is None:
            return [(self.now, self.scale)]
        return [self._at(t) for t in (1.0, *SHORTER)]

    def _at(self, t: float) -> tuple:
        w, scale = self.best
        # the scale stays above a tenth of what it was
        return w + t * self.step[:len(w)], scale if self.hinge else max(scale + t * self.step[-1], scale / 10)

    def _value(self, loss: float, point: tuple) -> float:
        return loss + self.fit.slot.penalty / 2 * float(self.shape @ point[0]**2)

    def band(self) -> float | None:
        """None: the least-squares start."""
        return None if self.stage < 0 else WIDTHS[self.stage] if self.hinge else 1.0

    def advance(self, block: np.ndarray) -> None:
        """The next point, from the sums at the present one."""
        d = len(self.now)
        n, losses, block = block[0], block[1:2 + len(SHORTER)], block[2 + len(SHORTER):]
        loss, grad, tail = losses[0], block[:d], block[d:2 + 2 * d]
        if not n:
            raise ValueError("a fold has no rows to learn from")
        upper = np.triu_indices(d)
        hess = np.zeros((d, d))
        hess[upper] = block[2 + 2 * d:]
        hess = (hess + np.triu(hess, 1).T) / n
        if self.stage < 0:
            if not self.hinge:  # the penalty of Huber's fit is that of weights on scaled features
                self.shape[:-1] = np.maximum(np.diag(hess)[:-1] - hess[:-1, -1] ** 2, 0.0)
            move = self._solve(hess, grad / n)
            left = 2 * loss / n + 2 * move @ (grad / n) + move @ hess @ move
            self.now, self.scale, self.stage = move, max(np.sqrt(max(left, 0.0)), 1e-12), 0
            return
        value = self._value(loss / n, (self.now, self.scale))
        if not np.isfinite(value):
            raise ValueError("the loss is not a finite number")
        if value > self.value:
            short = [self._value(x / n, point) for x, point in zip(losses, self.points())]
            best = int(np.argmin(short))
            self.failed += int(short[best] > self.value)
            if self.failed > 2:
                self._next_stage()
                return
            self.step = self.step * (1.0, *SHORTER)[best]
            self.now, self.scale = self._at(1.0)
            return
        self.best, self.value, self.failed = (self.now.copy(), self.scale), value, 0
        slope = grad / n + self.fit.slot.penalty * self.shape * self.now
        if self.hinge:
            step = self._solve(hess, slope)
            gain = -slope @ step / 2
        else:
            full = np.zeros((d + 1, d + 1))
            full[:d, :d], full[:d, d], full[d, :d], full[d, d] = hess, tail[2:] / n, tail[2:] / n, max(tail[1] / n, 1e-300)
            slope = np.append(slope, tail[0] / n)
            step = self._solve(full, slope)
            gain = -slope @ step / 2
        self.step = step
        last = not self.hinge or self.stage == len(WIDTHS) - 1
        if gain <= (FINE if last else ROUGH) * max(abs(value), 1e-12):
            self._next_stage()
        else:
            self.now, self.scale = self._at(1.0)

    def _solve(self, hess: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """A step downwards: the system is damped more where rounding has left it indefinite."""
        d = len(self.now)
        mean = np.append(np.full(d - 1, np.trace(hess[:d - 1, :d - 1]) / (d - 1)), hess[d - 1, d - 1])
        for damping in (DAMPING, 100 * DAMPING, 10_000 * DAMPING):
            system = hess.copy()
            system[np.arange(d), np.arange(d)] += self.fit.slot.penalty * self.shape + damping * mean + 1e-12
            step = -np.linalg.lstsq(system, slope, rcond=1e-13)[0]
            if slope @ step <= 0:
                break
        return step

    def _next_stage(self) -> None:
        self.now, self.scale = self.best[0].copy(), self.best[1]
        self.stage, self.value, self.failed, self.step = self.stage + 1, np.inf, 0, None
        self.done = not self.hinge or self.stage == len(WIDTHS)


def _losses(y: np.ndarray, score: np.ndarray, scale: float, band: float | None, hinge: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance to the answer, whether it lies in the curved part of the loss, and the loss of every row."""
    if band is None:
        err = score - y
        return err, np.ones(len(y), bool), 0.5 * err**2
    if hinge:
        short = 1 - y * score
        inside = np.abs(short) < band
        return short, inside, np.where(inside, (short + band) ** 2 / (4 * band), np.maximum(short, 0.0))
    err = score - y
    inside = np.abs(err) < EPSILON * scale
    return err, inside, scale + np.where(inside, err**2 / scale, 2 * EPSILON * np.abs(err) - EPSILON**2 * scale)


def _sums(z: np.ndarray, y: np.ndarray, fit: KernelFit, band: float | None, points: list[tuple]) -> np.ndarray:
    """Rows, losses of the points, and at the first one the gradient, what Huber's scale adds (slope, curvature, mixed terms) and the
    Hessian's upper triangle. ``z``: random features with a last column of ones."""
    y, hinge = (y if fit.target is None else np.where(y == fit.target, 1.0, -1.0)), fit.slot.loss == "hinge"
    wide = z.astype(np.float64)
    score = wide @ np.stack([w for w, _ in points], axis=1)
    losses = np.zeros(1 + len(SHORTER))
    for i in range(len(points) - 1, -1, -1):
        err, inside, value = _losses(y, score[:, i], points[i][1], band, hinge)
        losses[i] = value.sum()
    scale, mixed, extra = points[0][1], np.zeros(z.shape[1]), np.zeros(2)
    near = z if inside.all() else z[inside]
    if band is None:
        pull, curve = err, 1.0
    elif hinge:
        pull, curve = -y * np.where(inside, (err + band) / (2 * band), err > 0), 1 / (2 * band)
    else:
        pull, curve = np.where(inside, 2 * err / scale, 2 * EPSILON * np.sign(err)), 2 / scale
        extra = np.array([(1 - np.where(inside, (err / scale) ** 2, EPSILON**2)).sum(), (2 * err[inside] ** 2).sum() / scale**3])
        mixed = (-2 * err[inside] / scale**2) @ wide[inside]
    hess = (near.T @ near).astype(np.float64) * curve
    return np.concatenate([[len(z)], losses, pull @ wide, extra, mixed, hess[np.triu_indices(z.shape[1])]])


def _rows(df: DataFrame) -> DataFrame:
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(-1)
    return df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), fold.alias("fold"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y, fold = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for at in range(0, batch.num_rows, STEP_ROWS):
            yield x[at:at + STEP_ROWS], y[at:at + STEP_ROWS], fold[at:at + STEP_ROWS]


def _with_ones(z: np.ndarray) -> np.ndarray:
    return np.column_stack([z, np.ones(len(z), np.float32)])


def _add_up(rows: DataFrame, lifts: list[FourierMap], points: list[tuple]) -> np.ndarray:
    """One pass: the sums of every point, a row each. Fits of one map and fold share the random features."""
    groups: dict[tuple, list[int]] = {}
    for i, (lift, (fit, _, _)) in enumerate(zip(lifts, points)):
        groups.setdefault((lift, fit.fold), []).append(i)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for x, y, fold in _steps(batches):
            for (lift, out), members in groups.items():
                kept = slice(None) if out is None else fold != out
                z = _with_ones(lift.image(x[kept]))
                for i in members:
                    part = _sums(z, y[kept], *points[i])
                    total[i] = total[i] + part if i in total else part
        for i, block in total.items():
            places = range(0, len(block), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), i, np.int32)), pa.array(np.arange(len(places), dtype=np.int32)),
                                              pa.array([block[s:s + CHUNK].tobytes() for s in places], pa.binary())], ["fit", "chunk", "block"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(block.as_buffer(), np.float64) for block in parts.column("block"))
        return pa.table({"fit": parts.column("fit")[:1], "chunk": parts.column("chunk")[:1], "block": pa.array([total.tobytes()], pa.binary())})

    schema = "fit int, chunk int, block binary"
    sums = rows.mapInArrow(task, schema).groupBy("fit", "chunk").applyInArrow(add, schema).toArrow().sort_by([("fit", "ascending"), ("chunk", "ascending")])
    width = lifts[0].width + 1
    found = np.zeros((len(points), 4 + len(SHORTER) + 2 * width + width * (width + 1) // 2))
    for i, chunk, block in zip(*(sums.column(c).to_pylist() for c in ("fit", "chunk", "block"))):
        part = np.frombuffer(block, np.float64)
        found[i, chunk * CHUNK:chunk * CHUNK + len(part)] = part
    return found


def lifts_of(df: DataFrame, fits: list[KernelFit], n_features: int) -> list[FourierMap]:
    """The map of every fit; ``scale`` is that of the rows the fit learns from. One pass for all."""
    if all(f.slot.gamma != "scale" for f in fits):
        sums = {}
    else:
        fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(-1)
        sums = {r["fold"]: np.array([r["n"], r["s"], r["q"]]) for r in df.groupBy(fold.alias("fold")).agg(*_entry_sums(df, "features")).collect()}
    kept = lambda out: sum((s for f, s in sums.items() if out is None or f != out), np.zeros(3))
    return [FourierMap(_gamma(f.slot.gamma, n_features, *kept(f.fold)), n_features) for f in fits]


def fit_kernels(df: DataFrame, fits: list[KernelFit], n_features: int) -> list[tuple[FourierMap, np.ndarray]]:
    """Map and weights (the intercept last) of every fit. ``df`` has ``features``, ``label`` and, where fits leave folds out, ``fold``."""
    rows, out = _rows(df), []
    for at in range(0, len(fits), TURN):
        some = fits[at:at + TURN]
        lifts = lifts_of(df, some, n_features)
        searches = [_Search(f, m.width) for f, m in zip(some, lifts)]
        for _ in range(MOST_STEPS):
            open_ = [i for i, s in enumerate(searches) if not s.done]
            if not open_:
                break
            points = [(s.fit, s.band(), s.points()) for s in (searches[i] for i in open_)]
            for i, block in zip(open_, _add_up(rows, [lifts[i] for i in open_], points)):
                searches[i].advance(block)
        out += [(m, (s.now if s.best is None else s.best[0])) for m, s in zip(lifts, searches)]
    return out


def _guess(scores: np.ndarray, numbers: bool) -> np.ndarray:
    if numbers:
        return scores[:, 0]
    return (scores[:, 0] > 0).astype(np.float64) if scores.shape[1] == 1 else scores.argmax(axis=1).astype(np.float64)


def out_of_fold(df: DataFrame, fits: list[KernelFit], fitted: list[tuple[FourierMap, np.ndarray]], names: list[str]) -> DataFrame:
    """Predictions of each row by the fits that left its fold out: ``(model_id, fold, label, prediction, n)``. Fits of one name and
    fold are the classes of one model; of classes only counts leave a task."""
    models: dict[tuple, list[int]] = {}
    for i, (name, fit) in enumerate(zip(names, fits)):
        models.setdefault((name, fit.fold), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, fold in _steps(batches):
            for (name, out), members in models.items():
                mine = fold == out
                label, numbers = y[mine], fits[members[0]].target is None
                z = fitted[members[0]][0].image(x[mine]).astype(np.float64)
                guess = _guess(np.column_stack([z @ fitted[i][1][:-1] + fitted[i][1][-1] for i in members]), numbers)
                n = np.ones(len(label), np.int64)
                if not numbers and len(label):
                    (label, guess), n = np.unique(np.stack([label, guess]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(np.full(len(n), out, np.int32)), pa.array(label),
                                                  pa.array(guess), pa.array(n.astype(np.int64))], ["model_id", "fold", "label", "prediction", "n"])

    return _rows(df).mapInArrow(run, "model_id string, fold int, label double, prediction double, n long")


@dataclass
class KernelModel:
    """A model for scoring: the map, and weights with the intercept last (a row per class; one of two classes and of numbers)."""

    lift: FourierMap
    weights: np.ndarray
    numbers: bool

    def predict(self, features: Column) -> Column:
        """The prediction of an ``array<double>`` of features (class code or number)."""
        me = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            z = me.lift.image(np.stack(x.to_list()).astype(np.float64)).astype(np.float64)
            return pd.Series(_guess(z @ me.weights[:, :-1].T + me.weights[:, -1], me.numbers))

        return score(features)

    def to_json(self) -> str:
        return json.dumps({"lift": asdict(self.lift), "weights": self.weights.tolist(), "numbers": self.numbers})

    @classmethod
    def from_json(cls, text: str) -> "KernelModel":
        d = json.loads(text)
        return cls(FourierMap(**d["lift"]), np.array(d["weights"]), d["numbers"])


def targets_of(n_classes: int, numbers: bool) -> list[int | None]:
    return [None] if numbers else [1] if n_classes <= 2 else list(range(n_classes))


def fit_model(df: DataFrame, n_features: int, slot: KernelSlot, n_classes: int, numbers: bool) -> KernelModel:
    """A model of all rows of ``df`` (``features``, ``label``)."""
    fitted = fit_kernels(df, [KernelFit(slot, None, c) for c in targets_of(n_classes, numbers)], n_features)
    return KernelModel(fitted[0][0], np.stack([w for _, w in fitted]), numbers)
