"""M8: exact k-nearest-neighbour prediction at table scale.

Plan (exact, no candidate cap):
1. A sample of vectors (the rows with the smallest md5 hash of the id, at most ``SAMPLE_BYTES``) is cut into ``P`` cells by a tree of
   medians; P grows with the root of the corpus. Every corpus row goes to its cell, and per cell Spark counts rows and
   the bounding box. Big cells are split into sub-blocks by a hash of the id, so a cell holding a third of the rows is spread
   over many tasks. Cells and their blocks are a stored table that is joined; nothing in a plan grows with the corpus.
2. Every query searches the cells nearest to it that together hold k rows. The k-th distance found there is an upper bound.
3. Only cells whose box is no farther than that bound can hold a nearer row; the query is sent to the blocks of those.
4. ``cogroup`` on (cell, block): inside a block the rows are cut into leaves by the same medians, and a query meets the leaves whose
   box lies within its bound (in many dimensions the block is one leaf). Equal vectors are searched once, and of equal corpus
   rows only the smallest ids can be among the k. At most k rows per query and block leave the task, never all pairs.
5. A global top-k per query (``row_number() <= k``, which Spark plans as a partial group limit before the shuffle)
   and the vote: most frequent label, smallest label on ties (or the neighbour mean / 1-over-distance weights).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.functions.exprs import hash_fraction_key, qcol
from tablesmith.operators.codes import store
from tablesmith.session import cut_lineage

BLOCK_ROWS = 20_000          # corpus rows per (cell, block) group
ROWS_PER_PIVOT = 2_000       # corpus rows per cell at least
PIVOTS_PER_ROOT = 0.5         # at most so many cells per square root of the corpus size
SAMPLE_ROWS = 32              # of the sample per cell
SAMPLE_BYTES = 8 << 20        # of the sample, and of the boxes: the bound of their broadcast
QUERY_ROWS = 50_000          # queries of one group
QUERY_CHUNK = 2_000_000      # query x corpus distances computed at once inside a block
ROUTE_BYTES = 16 << 20       # of the routed queries of one Arrow batch
LEAF_ROWS = 128               # corpus rows of a leaf of a block
LEAF_DIMENSIONS = 32          # boxes of leaves exclude little in more dimensions
FIRST_LEAVES = 4              # leaves that give a query its first bound


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


# ---------------------------------------------------------------------------------------------------------------
# Cells and boxes
# ---------------------------------------------------------------------------------------------------------------


def _cut(x: np.ndarray, least: int) -> tuple[int, float] | None:
    """The dimension whose cut at the median takes most variance away, and the largest value on its low side."""
    if len(x) < 2 * least:
        return None
    middle = np.partition(x, len(x) // 2, axis=0)[len(x) // 2]
    low = np.where(middle >= x.max(axis=0), x < middle, x <= middle)
    n = low.sum(axis=0)
    m = len(x) - n
    part = np.where(low, x, 0.0).sum(axis=0)
    spread = part / np.maximum(n, 1) - (x.sum(axis=0) - part) / np.maximum(m, 1)
    gain = np.where((n >= least) & (m >= least), n * (m / len(x)) * spread * spread, 0.0)
    j = int(np.argmax(np.nan_to_num(gain)))
    return (j, float(x[low[:, j], j].max())) if gain[j] > 0 else None


@dataclass
class CellTree:
    """Cells by a tree of cuts: dimension (-1: a cell), largest value of the low side, low child (the high one follows it)."""

    dimension: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    rows: list                       # of each cell's node, the rows it was made of

    @classmethod
    def of(cls, x: np.ndarray, most: int, least: int, cells: int | None = None) -> "CellTree":
        """Nodes of more than ``most`` rows are cut, the largest first, until there are ``cells`` of them; none gets fewer than ``least`` rows."""
        dimension, cut, low, rows = [-1], [0.0], [0], [np.arange(len(x))]
        wait, made = [0], 1
        while wait and (cells is None or made < cells):
            node = wait.pop(0)
            found = _cut(x[rows[node]], least) if len(rows[node]) > most else None
            if found is None:
                continue
            left = x[rows[node], found[0]] <= found[1]
            dimension[node], cut[node], low[node] = *found, len(rows)
            wait += [len(rows), len(rows) + 1]
            rows += [rows[node][left], rows[node][~left]]
            dimension, cut, low = dimension + [-1, -1], cut + [0.0, 0.0], low + [0, 0]
            rows[node] = None
            made += 1
            if cells is not None:
                wait.sort(key=lambda i: -len(rows[i]))
        return cls(np.array(dimension), np.array(cut), np.array(low), rows)

    def leaves(self) -> list[np.ndarray]:
        return [r for r in self.rows if r is not None]

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The node of the cell of each row."""
        node, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            j = self.dimension[node[live]]
            live, j = live[j >= 0], j[j >= 0]
            at = node[live]
            node[live] = self.low[at] + (x[live, j] > self.cut[at])
        return node


def box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box, added up in the order of the dimensions, as distances to rows are: no row of a box is nearer."""
    out = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        v = x[:, j][:, None]
        d = np.maximum(np.maximum(low[:, j] - v, v - high[:, j]), 0.0)
        out += d * d
    return out


@dataclass
class Boxes:
    """The cells that have rows: number, rows, blocks and bounding box."""

    cell: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def routes(self, x: np.ndarray, need: int, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, cell, blocks of the cell): without a bound the nearest cells that together hold ``need`` rows (all, if none do),
        with one (squared) the others within it."""
        far = box_distances(x, self.low, self.high)
        by = np.argsort(far, axis=1, kind="stable")
        upto = np.cumsum(self.rows[by], axis=1)
        home = np.zeros(far.shape, bool)
        np.put_along_axis(home, by, upto - self.rows[by] < need, axis=1)
        q, at = np.nonzero(home if bound is None else ~home & ~(far > bound[:, None] * (1 + 1e-9)))
        return q, self.cell[at], self.blocks[at].astype(np.int64)


# ---------------------------------------------------------------------------------------------------------------
# Search inside a block
# ---------------------------------------------------------------------------------------------------------------


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one row of each distinct vector, and the distinct vector of each row."""
    x = np.ascontiguousarray(x + 0.0)  # one zero
    _, first, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    return first, which.ravel()


def _first_bounds(qv: np.ndarray, qn: np.ndarray, far: np.ndarray, tv: np.ndarray, tn: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The k-th approximate squared distance among the rows of each query's nearest leaves (infinite, if they hold fewer)."""
    best = np.full((len(qv), k), np.inf)
    by = np.argsort(far, axis=1, kind="stable")[:, :FIRST_LEAVES]
    for r in range(by.shape[1]):
        for leaf in np.unique(by[:, r]):
            at, span = np.flatnonzero(by[:, r] == leaf), slice(ends[leaf], ends[leaf + 1])
            near = qn[at][:, None] + tn[span] - 2.0 * (qv[at] @ tv[span].T)
            few = min(k, near.shape[1])
            near = np.concatenate([best[at], np.partition(near, few - 1, axis=1)[:, :few]], axis=1)
            best[at] = np.partition(near, k - 1, axis=1)[:, :k]
    return best.max(axis=1)


def search_block(qv: np.ndarray, bound: np.ndarray, tv: np.ndarray, tid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact k nearest rows per query (ties by id) among those within its squared bound: (query place, row place, squared distance).

    BLAS gives approximate squared distances |q|^2 + |t|^2 - 2 q.t; their rounding error is far below
    ``margin`` = 1e-9 (|q|^2 + max |t|^2), so every exact top-k row (ties included) lies within k-th approximate
    distance + 2 margin.  Only those candidates get the exact, dimension-by-dimension distance."""
    leaves = CellTree.of(tv, 2 * LEAF_ROWS, LEAF_ROWS // 4).leaves() if tv.shape[1] <= LEAF_DIMENSIONS else [np.arange(len(tv))]
    order = np.concatenate(leaves)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
    low, high = (np.stack([f(tv[x], axis=0) for x in leaves]) for f in (np.min, np.max))
    tv, tid = tv[order], tid[order]
    tn = (tv * tv).sum(axis=1)
    step = max(1, QUERY_CHUNK // max(len(leaves), int(np.diff(ends).max())))
    out = []
    for s in range(0, len(qv), step):
        x, limit = qv[s:s + step], bound[s:s + step].copy()
        qn = (x * x).sum(axis=1)
        far = box_distances(x, low, high) if len(leaves) > 1 else np.zeros((len(x), 1))
        free = np.flatnonzero(np.isinf(limit))
        if len(free):
            limit[free] = _first_bounds(x[free], qn[free], far[free], tv, tn, ends, k)
        limit += 2 * (1e-9 * (qn + tn.max()) + 1e-12)
        rows, cols = [], []
        for leaf in range(len(leaves)):
            at, span = np.flatnonzero(~(far[:, leaf] > limit)), slice(ends[leaf], ends[leaf + 1])
            if len(at):
                q, t = np.nonzero(qn[at][:, None] + tn[span] - 2.0 * (x[at] @ tv[span].T) <= limit[at][:, None])
                rows.append(at[q])
                cols.append(t + ends[leaf])
        if not rows:
            continue
        q, t = np.concatenate(rows), np.concatenate(cols)
        exact = np.zeros(len(q))
        for j in range(x.shape[1]):
            d = x[q, j] - tv[t, j]
            exact += d * d
        by = np.lexsort((tid[t], exact, q))
        q, t, exact = q[by], t[by], exact[by]
        keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
        out.append((q[keep] + s, order[t[keep]], exact[keep]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def block_topk(qv: np.ndarray, qids: np.ndarray, bound: np.ndarray, tv: np.ndarray, tid: np.ndarray, lab: np.ndarray, k: int,
               exclude_self: bool) -> pd.DataFrame:
    """The k nearest rows of a block per query within its bound; equal queries are searched once."""
    most = k + (int(np.unique(tid, return_counts=True)[1].max()) if exclude_self else 0)  # ids may repeat
    _, which = _distinct(tv)
    by = np.lexsort((tid, which))
    keep = by[np.arange(len(by)) - np.searchsorted(which[by], which[by], side="left") < most]
    first, which = _distinct(qv)
    widest = np.full(len(first), -np.inf)
    np.maximum.at(widest, which, bound)
    q, t, d2 = search_block(qv[first], widest, tv[keep], tid[keep], most)
    start = np.searchsorted(q, np.arange(len(first) + 1), side="left")
    n = np.diff(start)[which]
    row = np.repeat(np.arange(len(qv)), n)
    hit = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[:-1][which], n)
    t, d2 = keep[t[hit]], d2[hit]
    if exclude_self:
        other = qids[row] != tid[t]
        row, t, d2 = row[other], t[other], d2[other]
        some = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        row, t, d2 = row[some], t[some], d2[some]
    return pd.DataFrame({"qid": qids[row], "tid": tid[t], "label": lab[t], "d2": d2})


# ---------------------------------------------------------------------------------------------------------------
# Search over the table
# ---------------------------------------------------------------------------------------------------------------


def knn_neighbours(corpus: DataFrame, queries: DataFrame, *, id_col: str, vec_col: str, label_col: str, k: int = 5,
                   exclude_self: bool = False, n_pivots: int | None = None) -> DataFrame:
    """The ``k`` nearest corpus rows of every query: ``(qid, tid, label, d2, rn)``, ties to the smaller id.

    ``corpus`` holds ``(id, vec, label)``; ``queries`` holds ``(id, vec)``.  With ``exclude_self`` a query never
    counts the corpus row of the same id (leave-one-out when both sides are the same table). ``n_pivots`` sets the number of cells.
    A distance to or from a row without a vector (null, or a null in it) is unknown (``d2`` null) and ranks behind all others, by id.
    """
    c = corpus.select(qcol(id_col).cast("long").alias("tid"), qcol(vec_col).cast("array<double>").alias("tvec"),
                      qcol(label_col).alias("label"))
    q = queries.select(qcol(id_col).cast("long").alias("qid"), qcol(vec_col).cast("array<double>").alias("qvec"))

    known = lambda v: F.col(v).isNotNull() & ~F.exists(v, F.isnull)
    sides = c.select(F.lit(0).alias("side"), known("tvec").alias("known"), F.size("tvec").alias("d")).unionByName(
        q.select(F.lit(1).alias("side"), known("qvec").alias("known"), F.size("qvec").alias("d")))
    found = {r["side"]: r for r in sides.groupBy("side").agg(F.count_if("known").alias("n"), F.count_if(~F.col("known")).alias("unknown"),
                                                             F.max(F.when(F.col("known"), F.col("d"))).alias("d")).collect()}
    if not any(r["unknown"] for r in found.values()):
        return _known_neighbours(c, q, found[0]["n"] if 0 in found else 0, found[0]["d"] if 0 in found else 1, k, exclude_self, n_pivots)
    near = _known_neighbours(c.where(known("tvec")), q.where(known("qvec")), found[0]["n"] if 0 in found else 0,
                             found[0]["d"] if 0 in found else 1, k, exclude_self, n_pivots).drop("rn")

    def first(rows: DataFrame) -> DataFrame:
        """The rows of the smallest ids; k of them have another id than a query's."""
        w = Window.partitionBy("tid").orderBy(F.lit(0))
        return F.broadcast(rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).orderBy("tid").limit(2 * k).select("tid", "label"))

    full = near.groupBy(F.col("qid").alias("f")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = q.where(known("qvec")).join(full, F.col("qid") == F.col("f"), "left_anti")
    far = q.where(~known("qvec")).select("qid").crossJoin(first(c)).unionByName(short.select("qid").crossJoin(first(c.where(~known("tvec")))))
    if exclude_self:
        far = far.where(F.col("qid") != F.col("tid"))
    return _best(near.unionByName(far.withColumn("d2", F.lit(None).cast("double"))), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("d2").asc_nulls_last(), "tid")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def _known_neighbours(c: DataFrame, q: DataFrame, n_corpus: int, d: int, k: int, exclude_self: bool, n_pivots: int | None) -> DataFrame:
    """``knn_neighbours`` where every row has a vector of ``d`` numbers: ``c`` (tid, tvec, label), ``q`` (qid, qvec)."""
    spark, label_type = c.sparkSession, c.schema["label"].dataType.simpleString()
    if n_corpus == 0:
        return c.select(F.col("tid").alias("qid"), "tid", "label", F.lit(0.0).alias("d2"), F.lit(1).alias("rn"))
    fit = max(1, SAMPLE_BYTES // (16 * max(1, d)))
    p = n_pivots or max(1, min(int(PIVOTS_PER_ROOT * math.sqrt(n_corpus)), n_corpus // ROWS_PER_PIVOT, fit))
    sample = c.orderBy(hash_fraction_key(F.col("tid")), F.col("tid")).limit(min(SAMPLE_ROWS * p, fit)).select("tvec").collect()
    tree = CellTree.of(np.stack([np.asarray(r["tvec"], dtype=np.float64) for r in sample]), 1, 1, p)
    tree.rows = []
    bc = spark.sparkContext.broadcast(tree)

    def assign(it):
        for pdf in it:
            if not pdf.empty:
                yield pdf.assign(cell=bc.value.cell(_stack(pdf["tvec"])).astype("int32"))

    def outline(it):
        held: dict[int, tuple] = {}
        for pdf in it:
            if pdf.empty:
                continue
            x = _stack(pdf["tvec"])
            cell = bc.value.cell(x)
            by = np.argsort(cell, kind="stable")
            at = np.flatnonzero(np.diff(cell[by], prepend=-1))
            low, high = np.minimum.reduceat(x[by], at, axis=0), np.maximum.reduceat(x[by], at, axis=0)
            for i, n, a, b in zip(cell[by][at].tolist(), np.diff(at, append=len(by)).tolist(), low, high):
                m, c, e = held.get(i, (0, a, b))
                held[i] = (m + n, np.minimum(a, c), np.maximum(b, e))
        if held:  # a partition may be without rows
            yield pd.DataFrame({"cell": pd.Series(list(held), dtype="int32"), "n": pd.Series([v[0] for v in held.values()], dtype="int64"),
                                "low": [v[1] for v in held.values()], "high": [v[2] for v in held.values()]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1].to_numpy(), "n": [pdf["n"].sum()], "low": [_stack(pdf["low"]).min(axis=0)],
                             "high": [_stack(pdf["high"]).max(axis=0)]})

    # not cached: the assignment is a cheap numpy pass, recomputed by the stats job and by the block jobs
    assigned = c.mapInPandas(assign, f"tid long, tvec array<double>, label {label_type}, cell int")
    outlines = "cell int, n long, low array<double>, high array<double>"
    cells = c.select("tvec").mapInPandas(outline, outlines).groupBy("cell").applyInPandas(whole, outlines)
    cells = spark.read.parquet(store(cells.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")), "cells"))
    sizes = cells.orderBy("cell").toPandas()  # one row per cell
    boxes = spark.sparkContext.broadcast(Boxes(*[sizes[x].to_numpy() for x in ("cell", "n", "blocks")], *[_stack(sizes[x]) for x in ("low", "high")]))
    need = k + (1 if exclude_self else 0)

    def route(it):
        for pdf in it:
            # some queries at a time: what leaves in one batch does not grow with the number of cells
            width = 8 * max(1, d) + 64
            few = max(1, ROUTE_BYTES // (8 * max(1, len(boxes.value.cell))))
            for s in range(0, len(pdf), few):
                part = pdf.iloc[s:s + few]
                limit = part["bound"].to_numpy() if "bound" in part else None
                at, cell, blocks = boxes.value.routes(_stack(part["qvec"]), need, limit)
                ids, vectors = part["qid"].to_numpy(), part["qvec"].to_numpy()
                bound = np.full(len(part), np.inf) if limit is None else limit
                for a in range(0, len(at), 4096):
                    rows = np.repeat(np.arange(a, min(a + 4096, len(at))), blocks[a:a + 4096])
                    first = np.cumsum(blocks[a:a + 4096]) - blocks[a:a + 4096]
                    block = np.arange(len(rows)) - np.repeat(first, blocks[a:a + 4096])
                    for b in range(0, len(rows), max(1, ROUTE_BYTES // width)):
                        some = slice(b, b + max(1, ROUTE_BYTES // width))
                        yield pd.DataFrame({"qid": ids[at[rows[some]]], "qvec": vectors[at[rows[some]]], "bound": bound[at[rows[some]]],
                                            "cell": cell[rows[some]].astype("int32"), "block": block[some].astype("int32")})

    def search(asking: DataFrame) -> DataFrame:
        """The k best rows per query and block asked."""
        routed = asking.mapInPandas(route, "qid long, qvec array<double>, bound double, cell int, block int")
        # a block that many queries need is one group per QUERY_ROWS of them; its corpus rows go to each of the groups
        asked = routed.groupBy(F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("asked"))
        share = F.ceil(F.col("asked") / F.col("blocks") / QUERY_ROWS)
        deal = cells.join(asked, F.col("cell") == F.col("c")).select("cell", "blocks", F.greatest(F.lit(1), share).cast("int").alias("parts"))
        deal = spark.read.parquet(store(deal, "cell_parts"))
        routed = routed.join(deal.select("cell", "parts"), "cell").select(
            "qid", "qvec", "bound", "cell", "block", F.pmod(F.xxhash64("qid", F.lit(7)), F.col("parts")).cast("int").alias("part"))
        corpus_blocks = assigned.join(deal, "cell").select(
            "cell", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int").alias("block"), "tid", "tvec", "label",
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

        def nearest(key, qdf: pd.DataFrame, tdf: pd.DataFrame) -> pd.DataFrame:
            if qdf.empty or tdf.empty:
                return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "tid": pd.Series([], dtype="int64"),
                                     "label": pd.Series([], dtype="object"), "d2": pd.Series([], dtype="float64")})
            return block_topk(_stack(qdf["qvec"]), qdf["qid"].to_numpy(), qdf["bound"].to_numpy(), _stack(tdf["tvec"]), tdf["tid"].to_numpy(),
                              tdf["label"].to_numpy(), k, exclude_self)

        return routed.groupBy("cell", "block", "part").cogroup(corpus_blocks.groupBy("cell", "block", "part")).applyInPandas(
            nearest, f"qid long, tid long, label {label_type}, d2 double")

    home = cut_lineage(_best(search(q), k))
    if len(sizes) == 1:
        return home
    bounds = home.where(F.col("rn") == k).select(F.col("qid").alias("b"), F.col("d2").alias("bound"))
    others = q.join(bounds, F.col("qid") == F.col("b"), "left").select("qid", "qvec", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    return _best(home.drop("rn").unionByName(search(others)), k)


def knn_votes(neighbours: DataFrame, configs: list[tuple[int, str]], problem_type: str = "classification") -> DataFrame:
    """Predictions of several ``(k, weights)`` configurations from one neighbour table: ``(config, qid, prediction)``, where
    ``config`` is the place in the list. Each neighbour votes in the configurations whose ``k`` reaches it."""
    inverse = F.when(F.col("d2").isNotNull(), 1.0 / F.greatest(F.sqrt("d2"), F.lit(1e-12))).otherwise(0.0)  # an unknown distance has no weight
    ballots = F.array(*[F.struct(F.lit(i).alias("config"), F.lit(int(k)).alias("k"), (F.lit(1.0) if w == "uniform" else inverse).alias("wt"))
                        for i, (k, w) in enumerate(configs)])
    cast = neighbours.select("qid", "label", F.inline(F.filter(ballots, lambda b: F.col("rn") <= b["k"])))
    if problem_type == "classification":
        votes = cast.groupBy("config", "qid", "label").agg(F.sum("wt").alias("v"))
        return votes.groupBy("config", "qid").agg(F.min_by("label", F.struct((-F.col("v")).alias("nv"), F.col("label").isNull().alias("no"), F.col("label"))).alias("prediction"))
    y = F.col("label").cast("double")
    return cast.groupBy("config", "qid").agg(F.try_divide(F.sum(F.col("wt") * y), F.sum("wt")).alias("prediction"))


def knn_predict(corpus: DataFrame, queries: DataFrame, *, id_col: str, vec_col: str, label_col: str, k: int = 5,
                weights: str = "uniform", problem_type: str = "classification", exclude_self: bool = False,
                n_pivots: int | None = None) -> DataFrame:
    """Prediction per query row: ``(id_col, prediction)``; null where no corpus row is left to vote."""
    near = knn_neighbours(corpus, queries, id_col=id_col, vec_col=vec_col, label_col=label_col, k=k, exclude_self=exclude_self, n_pivots=n_pivots)
    pred = knn_votes(near, [(k, weights)], problem_type).drop("config")
    out = queries.select(qcol(id_col).cast("long").alias("qid")).join(pred, "qid", "left")
    return out.select(F.col("qid").alias(id_col), "prediction")


def knn_leave_one_out(df: DataFrame, *, id_col: str, vec_col: str, label_col: str, k: int = 5,
                      **kw) -> DataFrame:
    """Every row classified by its k nearest *other* rows of the same table."""
    return knn_predict(df, df.select(id_col, vec_col), id_col=id_col, vec_col=vec_col, label_col=label_col, k=k,
                       exclude_self=True, **kw)
