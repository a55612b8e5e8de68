"""Order statistics and quantiles of many column expressions in two passes.

The first pass builds one mergeable rank sketch per column (``percentile_approx``, whose rank error is at most ``n / accuracy``)
together with count, extremes and moments. The sketch's grid gives every wanted rank a bracket that is proven to
hold it. The second pass counts what lies below each bracket and sorts what lies inside it, and the executors read
the order statistics off; the driver gets one number per rank. Both passes take all columns at once.

A bracket that may hold more than ``BRACKET_ROWS`` rows (tables beyond some hundred million rows) is narrowed first by
sketches of the values inside it, and its values are counted rather than listed, so that memory stays bounded and a hot
value is one row. ``method="approx"`` takes the sketch's values as they are. ``"auto"`` and ``"bracket"`` are other names of
``"exact"``, which gives the linearly interpolated order statistic (the pandas / ``quantile_cont`` definition). NaN
counts as null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.exprs import no_nan
from tablesmith.operators.aggs import collect_agg

DEFAULT_ACCURACY = 10000
GRID = 1000              # steps of the sketch's probabilities
BRACKET_ROWS = 200_000   # rows or different values that a bracket holds at most when it is read
EXACT_NAMES = ("exact", "auto", "bracket")


@dataclass
class ColumnSketch:
    """What the first pass knows of a column: its place, count, extremes, sums and the values at the grid's probabilities."""

    place: int
    n: int
    low: float | None
    high: float | None
    total: float | None
    squares: float | None
    grid: list[float]
    accuracy: int

    def bracket(self, rank: int) -> tuple[float, float, int]:
        """Bounds that hold the ``rank``-th smallest value (from 0) and how many rows may lie between them."""
        slack = self.n / self.accuracy + 1
        first, last = math.floor((rank - slack) * GRID / self.n), math.ceil((rank + 1 + slack) * GRID / self.n)
        low = self.low if first <= 0 else self.grid[first]
        high = self.high if last >= GRID else self.grid[last]
        return low, high, math.ceil((min(last, GRID) - max(first, 0)) * self.n / GRID + 2 * slack)

    def near(self, rank: float) -> float:
        """The sketch's own value at a rank."""
        return self.grid[round(rank * GRID / max(1, self.n - 1))]


@dataclass
class RankSketch:
    """The sketches of several columns over the frame ``values`` (columns ``v0``, ``v1``, ...), and its number of rows."""

    values: DataFrame
    rows: int
    columns: dict[str, ColumnSketch]


def sketch_ranks(df: DataFrame, exprs: dict[str, Column], accuracy: int = DEFAULT_ACCURACY) -> RankSketch:
    """First pass over all columns."""
    names = list(exprs)
    values = df.select(*[no_nan(exprs[n].cast("double")).alias(f"v{i}") for i, n in enumerate(names)])
    at = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",").cast("array<double>")  # a constant
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(names)):
        v = F.col(f"v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.sum(v).alias(f"s{i}"),
                 F.sum(v * v).alias(f"q{i}"), F.percentile_approx(v, at, accuracy).alias(f"g{i}")]
    row = collect_agg(values, aggs, chunk=181)
    return RankSketch(values, row["rows"], {n: ColumnSketch(i, row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"s{i}"], row[f"q{i}"],
                                                            row[f"g{i}"] or [], accuracy) for i, n in enumerate(names)})


def order_statistics(sketch: RankSketch, wanted: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """Second pass: ``{column: {rank: value}}`` for ranks from 0 to n - 1, exact."""
    out: dict[str, dict[int, float]] = {name: {} for name in wanted}
    names, aggs, large = {c.place: name for name, c in sketch.columns.items()}, [], []
    asked = []
    for name, ranks in wanted.items():
        column = sketch.columns[name]
        for rank in sorted(set(ranks)):
            low, high, most = column.bracket(rank)
            if most > BRACKET_ROWS and low < high:
                large.append({"i": column.place, "rank": rank, "lo": low, "hi": high, "margin": 2.0 / column.accuracy})
            else:
                asked.append((name, rank))
                aggs.append(_read_off(F.col(f"v{column.place}"), rank, low, high).alias(f"r{len(asked) - 1}"))
    if aggs:
        row = collect_agg(sketch.values, aggs, chunk=100)
        for k, (name, rank) in enumerate(asked):
            if row[f"r{k}"] is None:  # not in its bracket after all: start from the whole range
                c = sketch.columns[name]
                large.append({"i": c.place, "rank": rank, "lo": c.low, "hi": c.high, "margin": 2.0 / c.accuracy})
            else:
                out[name][rank] = row[f"r{k}"]
    if large:
        for t, (below, inside, values) in zip(large, _count(sketch.values, large, [(t["lo"], t["hi"]) for t in large])):
            t.update(below=below, rows=inside, values=values)
        _narrow(sketch.values, large, sketch.columns[names[large[0]["i"]]].accuracy)
        for t, value in zip(large, _read_histogram(sketch.values, large)):
            out[names[t["i"]]][t["rank"]] = value
    return out


def _read_off(v: Column, rank: int, low: float, high: float) -> Column:
    """The value at ``rank``, from the rows below the bracket, the copies of its bounds and the sorted rest inside."""
    lo, hi = F.lit(low), F.lit(high)
    below, first = F.count_if(v < lo), F.count_if(v == lo)
    if low == high:
        return F.when((below <= rank) & (rank < below + first), lo)
    inside = F.array_sort(F.collect_list(F.when((v > lo) & (v < hi), v)))
    place = (F.lit(rank) - below - first).cast("int")
    return (F.when(below > rank, F.lit(None).cast("double")).when(place < 0, lo)
            .when(place < F.size(inside), F.get(inside, place))
            .when(place < F.size(inside) + F.count_if(v == hi), hi))


def quantiles(df: DataFrame, exprs: dict[str, Column], probs: list[float], method: str = "exact",
              accuracy: int = DEFAULT_ACCURACY) -> dict[str, list[float | None]]:
    """Return ``{name: [q(p) for p in probs]}``; None where the expression has no non-null value."""
    if not exprs:
        return {}
    check_method(method)
    sketch = sketch_ranks(df, exprs, accuracy)
    return sketched_quantiles(sketch, {n: [p * (c.n - 1) for p in probs] if c.n else [] for n, c in sketch.columns.items()}, method, len(probs))


def check_method(method: str) -> None:
    if method not in (*EXACT_NAMES, "approx"):
        raise ValueError(f"unknown quantile method {method!r}")


def sketched_quantiles(sketch: RankSketch, ranks: dict[str, list[float]], method: str, width: int) -> dict[str, list[float | None]]:
    """Interpolated values at fractional ranks; ``width`` Nones for a column that has none."""
    if method == "approx":
        return {n: [sketch.columns[n].near(r) for r in rs] if rs else [None] * width for n, rs in ranks.items()}
    found = order_statistics(sketch, {n: [x for r in rs for x in (math.floor(r), math.ceil(r))] for n, rs in ranks.items() if rs})
    return {n: [between(found[n][math.floor(r)], found[n][math.ceil(r)], r) for r in rs] if rs else [None] * width for n, rs in ranks.items()}


def between(low: float, high: float, rank: float) -> float:
    """Linear interpolation between the order statistics around a fractional rank."""
    return low if low == high else low + (high - low) * (rank - math.floor(rank))


# ---------------------------------------------------------------------------------------------------------------
# Brackets of very large tables
# ---------------------------------------------------------------------------------------------------------------


def _count(values: DataFrame, targets: list[dict], brackets: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Per bracket: values below it, inside it, and (estimated) different ones inside it."""
    aggs = []
    for k, (t, (lo, hi)) in enumerate(zip(targets, brackets)):
        v = F.col(f"v{t['i']}")
        inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
        aggs += [F.count_if(v < F.lit(lo)).alias(f"b{k}"), F.count_if(inside).alias(f"c{k}"),
                 F.approx_count_distinct(F.when(inside, v), 0.05).alias(f"d{k}")]
    row = collect_agg(values, aggs, chunk=60)
    return [(row[f"b{k}"], row[f"c{k}"], row[f"d{k}"]) for k in range(len(targets))]


def _narrow(values: DataFrame, targets: list[dict], accuracy: int) -> None:
    """Shrink brackets until each holds few enough rows or different values."""
    def wide(t: dict) -> bool:
        return t["lo"] < t["hi"] and t["rows"] > BRACKET_ROWS and t["values"] > BRACKET_ROWS

    while pending := [t for t in targets if wide(t)]:
        aggs = []
        for k, t in enumerate(pending):
            v = F.col(f"v{t['i']}")
            at = (t["rank"] - t["below"]) / max(1, t["rows"] - 1)
            ends = F.array(F.lit(max(0.0, at - t["margin"])), F.lit(min(1.0, at + t["margin"])))
            aggs.append(F.percentile_approx(F.when((v >= F.lit(t["lo"])) & (v <= F.lit(t["hi"])), v), ends, accuracy).alias(f"e{k}"))
        row = collect_agg(values, aggs, chunk=60)
        inner = [tuple(row[f"e{k}"]) for k in range(len(pending))]
        for t, (lo, hi), (b, c, d) in zip(pending, inner, _count(values, pending, inner)):
            if b <= t["rank"] < b + c and (lo, hi) != (t["lo"], t["hi"]):
                t.update(lo=lo, hi=hi, below=b, rows=c, values=d, margin=2.0 / accuracy)
            elif t["margin"] >= 1.0:
                t["values"] = 0  # nothing left to shrink: count what is there
            else:
                t["margin"] *= 4  # the sketch missed, or nothing shrank: a wider try


def _read_histogram(values: DataFrame, targets: list[dict]) -> list[float]:
    """The value at each target's rank, from running counts of the different values inside its bracket."""
    cells = []
    for b, t in enumerate(targets):
        v = F.col(f"v{t['i']}")
        cells.append(F.when((v >= F.lit(t["lo"])) & (v <= F.lit(t["hi"])), F.struct(F.lit(b).alias("b"), v.alias("v"))))
    hist = values.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull()))).groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = F.array(*[F.lit(t["rank"] - t["below"]).cast("long") for t in targets])
    run = hist.withColumn("upto", upto).withColumn("r", F.element_at(ranks, F.col("b") + 1))
    rows = run.where((F.col("upto") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("upto"))).select("b", "v").collect()
    found = {r["b"]: float(r["v"]) for r in rows}
    return [found[b] for b in range(len(targets))]
