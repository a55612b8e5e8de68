"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import cut, steps, word_codes
from tablesmith.llm.quality_rules import base_counts

#: Random features, ridge penalty per training row, and half-width to which standardised statistics are clipped.
FEATURES, PENALTY, CLIP = 256, 1e-4, 4.0
SEED = 11
#: Training rows whose crc32(key) mod 5 is CALIBRATE fit the calibration, those with 0 are held out, the others the ridge.
FOLDS, CALIBRATE = 5, 4
#: Cells of raw scores between -1 and 2 over which the calibration counts labels.
CELLS = 6000
#: Tasks that add up the partial normal equations before the driver adds theirs.
FAN_IN = 16
THRESHOLD = 0.3

#: Byte classes counted in a text: name, bytes.
CLASSES = (
    ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", bytes(range(48, 58))),
    ("stop", b".?"), ("comma", b",;:"), ("bang", b"!"), ("pipe", b"|"), ("symbol", b"#*$%&<>"),
    ("other", b"\"'()+-/=@[\\]^_`{}~"), ("high", bytes(range(128, 256))), ("line", b"\n"),
)
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, (_, _members) in enumerate(CLASSES):
    _CLASS_OF[list(_members)] = _i

STATISTICS = ("words", "word_chars", "distinct", "top_word", "echo", "symbols", "dup_lines", "repeats", "line_words", "bytes_word",
              *[name for name, _ in CLASSES])


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per whole text; an empty or null text has zeros."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    base = base_counts(texts)
    words = np.maximum(base["n_words"], 1).astype(float)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    sizes = np.array([len(b) for b in raw], np.int64)
    shares = np.zeros((n, len(CLASSES)))
    kinds = _CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)]
    some = np.flatnonzero(sizes)
    if len(some):
        begin = (np.cumsum(sizes) - sizes)[some]
        for i in range(len(CLASSES)):
            shares[some, i] = np.add.reduceat(kinds == i, begin, dtype=np.int64)
    codes, _, counts = word_codes(texts)
    owner = np.repeat(np.arange(n), counts)
    pair, times = np.unique(owner * np.int64(max(codes.max(initial=0) + 1, 1)) + codes, return_counts=True)
    whose = pair // np.int64(max(codes.max(initial=0) + 1, 1))
    distinct = np.bincount(whose, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, whose, times)
    echo = np.bincount(owner[1:][(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
    lines = np.maximum(base["n_lines"], 1)
    columns = [np.log1p(base["n_words"]), base["word_chars"] / words, distinct / words, top / words, echo / words, base["n_symbols"] / words,
               base["n_dup_lines"] / lines, base["n_repeat_words"] / words, np.log1p(base["n_words"] / lines), sizes / words]
    per = np.where(np.array([name in ("upper", "lower", "digit", "high") for name, _ in CLASSES]), np.maximum(sizes, 1)[:, None], words[:, None])
    return np.column_stack([*columns, shares / per])


def text_statistics(docs: DataFrame, text: str, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc``, the ``keep`` columns (as ``k0``, ...) and ``x`` (array of statistics) per document, from one pass over the texts."""
    slim = docs.select(F.col(text).alias("t"), F.col(key).alias("doc"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f.simpleString().replace(":", " ", 1) for f in slim.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                x = statistics(part.column(0))
                offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))],
                                                 [*part.schema.names[1:], "x"])

    return slim.mapInArrow(run, ", ".join([*fields, "x array<double>"]))


class Fourier:
    """Standardised statistics mapped to cosines of random projections, whose products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.weight = rng.normal(0.0, np.sqrt(1.0 / len(mean)), (len(mean), features))
        self.phase = rng.uniform(0.0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        # the plain statistics stand beside the random features, so a linear trend needs no cosines
        return np.column_stack([np.ones(len(x)), z, np.cos(z @ self.weight + self.phase) * np.sqrt(2.0 / len(self.phase))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_ridge(rows: DataFrame, features: Fourier, penalty: float = PENALTY) -> np.ndarray | None:
    """Ridge weights for ``y`` on the features of ``x`` over all rows; None without rows.

    Every task adds up its part of the normal equations; ``FAN_IN`` tasks add the parts, and the driver adds
    at most ``FAN_IN`` matrices of fixed size.
    """
    width = 1 + len(features.mean) + len(features.phase)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 2))
        for batch in batches:
            if batch.num_rows:
                z, y = features(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False)
                total += np.column_stack([z.T @ z, z.T @ y, np.full(width, float(len(y)))])
        if total[0, -1]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width + 2)), False
        for batch in batches:
            for raw in batch.column(0):
                total, seen = total + np.frombuffer(raw.as_py()).reshape(width, width + 2), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    sums = rows.select("x", "y").mapInArrow(part, "sums binary").repartition(FAN_IN).mapInArrow(add, "sums binary").collect()
    if not sums:
        return None
    total = np.sum([np.frombuffer(bytes(r[0])).reshape(width, width + 2) for r in sums], axis=0)
    return np.linalg.solve(total[:, :width] + penalty * total[0, -1] * np.eye(width), total[:, width])


def isotonic(cell: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over counted cells: (cell centre, calibrated value) per block."""
    blocks: list[list[float]] = []
    for c, k, s in sorted(zip(cell.tolist(), n.tolist(), ones.tolist())):
        blocks.append([c * k, k, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks, float).reshape(-1, 3)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def _scored(rows: DataFrame, features: Fourier, weights: np.ndarray, knots: tuple | None = None) -> DataFrame:
    """Add ``raw`` (the ridge value) and ``score``: calibrated where there are ``knots``, else clipped.

    A calibrated score is linear between the blocks' centres, with a thousandth of the raw value to keep its order.
    """
    names = [c for c in rows.columns if c != "x"]
    schema = ", ".join([*[f.simpleString().replace(":", " ", 1) for f in rows.schema.fields if f.name != "x"], "raw double", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(features(_matrix(batch.column("x"))) @ weights, -1.0, 2.0) if batch.num_rows else np.zeros(0)
            score = np.interp(raw, *knots) * 0.999 + (raw + 1) / 3 * 0.001 if knots else raw
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(raw), pa.array(np.clip(score, 0.0, 1.0))],
                                             [*names, "raw", "score"])

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
                    threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Quality score of every document: ``key``, the ``keep`` columns, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Statistics of the whole texts are standardised over all documents. Labelled documents outside the held-out fold
    (crc32 of the key as text mod 5 is 0) give partition sums of ridge normal equations over random Fourier features;
    one of their folds is kept from the ridge and gives the isotonic calibration, over counted cells of the raw score.
    Only the statistics enter a score.

    Nulls: a null text is empty, a null label is no label, a null key is never held out and never labelled. Repeated rows
    count each. Without labels every score is 0.5; without calibration rows the raw score is clipped to 0..1. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = cut(text_statistics(docs, text, key, keep), "statistics")
    kept = [f"k{i}" for i in range(len(keep))]
    fold = F.crc32(F.col("doc").cast("string")) % FOLDS
    held = F.coalesce(fold == 0, F.lit(False))
    width = len(STATISTICS)
    moments = rows.agg(*[f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("lk"), F.col(label).cast("double").alias("y"))
    train = cut(rows.join(known, F.col("doc") == F.col("lk")).filter(fold != 0).select("x", "y", fold.alias("fold")), "training")
    weights = features = None
    if moments[0] is not None:
        features = Fourier(np.array(moments[0::2], float), np.array(moments[1::2], float))
        weights = fit_ridge(train.filter(F.col("fold") != CALIBRATE), features)
    if weights is None:
        scored = rows.select("doc", *kept, F.lit(0.5).alias("score"))
    else:
        counted = (_scored(train.filter(F.col("fold") == CALIBRATE).select("x", "y"), features, weights)
                   .groupBy(F.floor(F.col("raw") * (CELLS / 3)).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect())
        knots = None
        if counted:
            c, n, ones = (np.array(v, float) for v in zip(*counted))
            knots = isotonic((c + 0.5) * 3 / CELLS, n, ones)
        scored = _scored(rows, features, weights, knots)
    return scored.select(F.col("doc").alias(key), *[F.col(k).alias(c) for k, c in zip(kept, keep)], held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
