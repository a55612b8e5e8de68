"""Helpers shared by the operators: scratch tables, global row numbers, word arrays, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablesmith.session import scratch_path

#: Bytes of text that one step inside a Python task works on (one longer text is a step of its own).
STEP_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage, survives lost executors, and gives later joins a table whose size Spark knows, so that it
    broadcasts only what is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the exact 0-based rank ``name`` of each row in the total order of ``order``, without a one-task window.

    A range shuffle sorts the rows; each row gets its place inside its partition from
    ``monotonically_increasing_id`` and the partition's offset from a prefix sum over partition totals. The offsets
    have one row per partition, which bounds their broadcast. The sorted rows are written once, so that both uses see
    the same partitions.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", 33)
    totals = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__part", "__place", "__before"))


def steps(batch: pa.RecordBatch, column: str | int, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``most`` bytes of ``column`` (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_codes(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of whole texts: codes of all words in order, the distinct words, words per text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    counts = np.bincount(owner[filled], minlength=len(texts)).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def connected_components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """Smallest reachable node per node of an undirected edge list: columns ``node``, ``root``.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each a group minimum with map-side combine and
    a join on the node, until the edges no longer change. Every round is written to the shared folder.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = cut(both, name)
    mark = None
    while True:
        # large star: every larger neighbour of a node points to the smallest one around that node
        sym = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        low = low.select("c", F.least("c", "m").alias("m"))
        large = (sym.join(low, sym.u == low.c).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = cut(large, name)
        # small star: the smaller neighbours of a node and the node itself point to the smallest of them
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = (large.join(low, large.u == low.c).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        now = cut(small, name)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = state
