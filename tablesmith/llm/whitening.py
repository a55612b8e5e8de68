"""Embedding whitening by shifted CholeskyQR: Gram passes over centred rows, composed triangular factors, SVD of the product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import cut

#: Rows count as orthonormal when the eigenvalues of their Gram matrix are this close to 1 (times the dimension), or below
#: DEAD in directions without variance; factors at least and at most.
ORTHONORMAL, DEAD, LEAST_PASSES, MOST_PASSES = 1e-12, 1e-6, 3, 8
#: Rows in one block of a task.
BLOCK = 4096
#: A component is left out when its deviation is below this share of the largest one's (only
#: rounding is left there).
LEAST_SHARE = 1e-11
#: Grid of the entries: ``floor(SCALE * c) + OFFSET``; entries beyond +-LARGEST on that grid are not held exactly.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 46


@dataclass
class Whitener:
    """Fitted whitening: ``n`` rows, integer ``sums`` per dimension, triangular ``factors`` in the order of their passes,
    ``turn`` (left singular vectors of their product) and eigenvalues ``values`` by falling size; ``trace`` of the covariance."""

    n: int
    sums: np.ndarray
    factors: list[np.ndarray] = field(default_factory=list)
    turn: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` with one rounding: the difference ``n * x - S`` is an exact integer."""
        return (self.n * x - self.sums) / np.float64(self.n)

    def orthonormal(self, x: np.ndarray) -> np.ndarray:
        rows = self.centred(x)
        for factor in self.factors:
            rows = solve_rows(rows, factor)
        return rows

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over the square root of their eigenvalues."""
        return self.orthonormal(x) @ self.turn * np.sqrt(np.float64(self.n))


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows @ inv(upper)`` by forward substitution over the columns."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def grid_rows(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """Columns ``k0``.. and ``x`` (array of long): the rows whose vectors take part, written once.

    Dropped: vectors that are null or empty, with a null or non-finite entry or one beyond the grid; and, where
    lengths differ, all that do not have the most frequent length (the shorter of two as frequent).
    """
    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(LARGEST))

    cells = F.col(vector).cast("array<double>")
    slim = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], cells.alias("v"))
    whole = slim.filter((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(fine(c), F.lit(False))))
    gridded = F.transform("v", lambda c: F.floor(c * SCALE) + OFFSET)
    keys = [f"k{i}" for i in range(len(keep))]
    stored = cut(whole.select(*keys, gridded.cast("array<bigint>").alias("x")), "grid")
    sizes = stored.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").limit(1).collect()
    return stored.filter(F.size("x") == (common[0]["d"] if common else 0))


def _blocks(batch: pa.RecordBatch, column: int = -1) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as a matrix."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _sums(gridded: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and exact sums per dimension."""
    rows = (gridded.select(F.posexplode("x").alias("i", "x")).groupBy("i")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.max(F.abs("x")).alias("top")).orderBy("i").collect())
    n = rows[0]["n"] if rows else 0
    if any(2 * n * r["top"] >= 1 << 63 for r in rows):
        raise ValueError("rows times the largest entry exceed 64 bits: use a coarser grid")
    return n, np.array([r["s"] for r in rows], np.int64)


def _gram(gridded: DataFrame, image, width: int) -> np.ndarray:
    """``Y.T @ Y`` of the rows ``Y = image(x)``: one triangle per task, added up by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in batches:
            for _, x in _blocks(batch):
                y, seen = image(x), True
                total += y.T @ y
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                                             ["i", "row"])

    parts = gridded.select("x").mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "g")).filter("j >= i").groupBy("i", "j").agg(F.sum("g").alias("g"))
    gram = np.zeros((width, width))
    for r in cells.collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["g"]
    return gram


def _factor(gram: np.ndarray) -> np.ndarray:
    """Upper Cholesky factor of ``gram``, shifted unless its rows are nearly orthonormal already.

    The shift bounds the rounding of one block's Gram matrix; where that is too little, ten times as much.
    """
    d = len(gram)
    if np.abs(gram - np.eye(d)).max() < 0.5 / d:
        return np.linalg.cholesky(gram).T
    shift = 11 * (BLOCK * d + d * (d + 1)) * (np.finfo(np.float64).eps / 2) * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit_whitening(gridded: DataFrame, most: int = 32) -> Whitener | None:
    """Fit on the ``x`` of all rows of :func:`grid_rows`; None where no row or no variance is left.

    Each pass reads the rows, solves them through the factors found so far and adds up their Gram matrix (one triangle per
    task; the driver gets d * d numbers). Its Cholesky factor joins the list; a shift keeps the first factors safe however
    close to singular the data is, and the passes go on until the rows are orthonormal. The product R of the factors has
    the singular values and right vectors of the centred rows, so its SVD gives the components. A dimension of one value, or one that
    depends on others, leaves a direction in which the last Gram matrix is 0 and not 1; R is taken without it.
    """
    n, sums = _sums(gridded)
    if not n:
        return None
    fit, d = Whitener(n, sums), len(sums)
    for _ in range(MOST_PASSES):
        gram = _gram(gridded, fit.orthonormal, d)
        if not fit.factors:
            if not gram.trace() > 0:
                return None
            fit.trace = gram.trace() / n
        spectrum, axes = np.linalg.eigh(gram)
        living = spectrum > 0.5
        settled = np.where(living, np.abs(spectrum - 1) < ORTHONORMAL * d, spectrum < DEAD).all()
        if settled and len(fit.factors) >= LEAST_PASSES:
            break
        fit.factors.append(_factor(gram))
    product = np.eye(d)
    for factor in fit.factors:
        product = factor @ product
    left, sigma, right = np.linalg.svd(axes[:, living].T @ product, full_matrices=False)
    left = axes[:, living] @ left
    wide = min(int((sigma > LEAST_SHARE * sigma[0]).sum()), most, n - 1)
    sign = np.sign(right[np.arange(wide), np.abs(right[:wide]).argmax(axis=1)])
    fit.turn, fit.values = left[:, :wide] * sign, sigma[:wide] ** 2 / n
    return fit


def identity_error(gridded: DataFrame, fit: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, from a pass over all rows."""
    width = len(fit.values)
    return float(np.abs(_gram(gridded, fit.whiten, width) / fit.n - np.eye(width)).max())


def deviations(fit: Whitener, x: np.ndarray) -> list[int | None]:
    """Sum of ``(n * x - S)^2`` per row, exact; None where it exceeds 64 bits."""
    delta = fit.n * x - fit.sums
    top = int(np.abs(delta).max(initial=0))
    if top * top * delta.shape[1] < 1 << 63:
        return (delta * delta).sum(axis=1).tolist()
    exact = (delta.astype(object) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), most: int = 32) -> DataFrame:
    """Whitened rows over the first ``most`` principal components of the gridded vectors.

    One row per row that takes part (see :func:`grid_rows`): the ``keep`` columns, ``n`` (rows of the fit), ``deviation`` (exact sum
    of ``(n * x - S)^2``; null beyond 64 bits), ``whitened`` and ``explained`` (arrays, by falling eigenvalue) and
    ``identity_error``. Components without variance are left out, so rows of a table of one value, or of one row, get no row
    at all. Of two orientations the one whose largest entry is positive is taken.

    Nulls: a null vector takes no part, a null key is carried through. Repeated rows count and are returned each.
    Columns that are not in ``keep`` are ignored, whatever their names. An empty table gives an empty result.
    """
    gridded = grid_rows(rows, vector, list(keep))
    fit = fit_whitening(gridded, most)
    keys = [f"k{i}" for i in range(len(keep))]
    fields = [f.simpleString().replace(":", " ", 1) for f in gridded.schema.fields[:-1]]
    schema = ", ".join([*fields, "n long", "deviation long", "whitened array<double>", "explained array<double>", "identity_error double"])
    error = identity_error(gridded, fit) if fit is not None else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if fit is None:
                continue
            share = pa.array([(fit.values / fit.trace).tolist()], pa.list_(pa.float64()))
            for part, x in _blocks(batch):
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.full(m, fit.n, np.int64)), pa.array(deviations(fit, x), pa.int64()),
                     pa.array(list(fit.whiten(x)), pa.list_(pa.float64())), share.take(pa.array(np.zeros(m, np.int64))),
                     pa.array(np.full(m, error))],
                    [*part.schema.names[:-1], "n", "deviation", "whitened", "explained", "identity_error"])

    out = gridded.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, keep)], "n", "deviation", "whitened", "explained", "identity_error")
