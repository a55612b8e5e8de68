"""ST1: fold a log of update events into the latest state per run.

Overwrite keys keep their last value by sequence number (``max_by``); append keys are *not* gathered into one
growing array per run (a run may hold a third of all events) — the run keeps their count and the appended values
stay a long table ``(run, seq, value)``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.exprs import qcol
from tablesmith.session import checkpoint_dir


def fold_state(events: DataFrame, run: str, seq: str, overwrite: list[str], append: list[str]) -> DataFrame:
    """Batch or streaming: ``(run, last_<key>..., n_<key>...)`` per run."""
    aggs = [F.max_by(qcol(k), qcol(seq)).alias(f"last_{k}") for k in overwrite]
    aggs += [F.count(qcol(k)).alias(f"n_{k}") for k in append]
    return events.groupBy(qcol(run)).agg(*aggs)


def appended_items(events: DataFrame, run: str, seq: str, key: str) -> DataFrame:
    """The appended values of one append key as a long table, ordered within a run by ``seq`` when read."""
    return events.where(qcol(key).isNotNull()).select(qcol(run), qcol(seq), qcol(key))


def run_state_stream(spark: SparkSession, source: DataFrame, run: str, seq: str, overwrite: list[str], append: list[str],
                     sink_dir: str, checkpoint: str | None = None) -> DataFrame:
    """Fold a stream until its present end and return the state per run.

    The running state is kept in the state store; each micro-batch writes the changed runs with the batch's number below
    ``sink_dir`` (a replayed batch overwrites its own folder), and the last version of each run is read back.
    """
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "streams", os.path.basename(sink_dir.rstrip("/")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))

    folded = fold_state(source, run, seq, overwrite, append)
    query = folded.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    states = spark.read.parquet(sink_dir)
    last = states.groupBy(qcol(run)).agg(F.max_by(F.struct(*[qcol(c) for c in folded.columns]), "batch_id").alias("s"))
    return last.select("s.*")


# ---------------------------------------------------------------------------------------------------------------
# Keyed state: late and repeated events
# ---------------------------------------------------------------------------------------------------------------

#: What the keyed state emits: a value that was appended, or a key's last value with its sequence number.
UPDATES = "seq long, name string, value string"


def _given(events: DataFrame, name: str) -> Column:
    """Is there a value? NaN is none."""
    filled = qcol(name).isNotNull()
    return filled & ~F.isnan(qcol(name)) if isinstance(events.schema[name].dataType, (T.DoubleType, T.FloatType)) else filled


def keyed_updates(source: DataFrame, run: str, seq: str, overwrite: list[str], append: list[str], time: str | None = None,
                  late: str = "1 hour") -> DataFrame:
    """Updates ``(run, seq, name, value)`` of a stream of events that may come late, out of order or more than once; started in update mode.

    The state of an append key holds the sequence numbers seen per run: an appended value is emitted once, however often its event
    comes. The state of an overwrite key is its last value with that value's number: each micro-batch that has events of a run
    emits it, and an earlier event changes nothing, so events may come in any order. ``time`` names an event-time column; then
    events more than ``late`` behind are dropped and the numbers of older ones go. Without it the state keeps every sequence
    number. Needs the RocksDB state store (:func:`run_keyed_stream` sets it).
    """
    needed = list(dict.fromkeys([run, seq, *overwrite, *append, *([time] if time else [])]))
    events = (source.withWatermark(time, late) if time else source).select(*[qcol(c) for c in needed])
    once = events.dropDuplicatesWithinWatermark([run, seq]) if time else events.dropDuplicates([run, seq])
    item = lambda name: F.struct(qcol(seq).cast("long").alias("seq"), F.lit(name).alias("name"), qcol(name).cast("string").alias("value"))
    parts = []
    if append:
        items = F.array(*[F.when(_given(events, c), item(c)) for c in append])
        parts.append(once.select(qcol(run), F.inline(F.filter(items, lambda x: x.isNotNull()))))
    if overwrite:
        # a repeated event leaves the last value as it is, so only late ones have to go first
        last = (once if time else events).groupBy(qcol(run)).agg(*[F.max(F.when(_given(events, c), item(c))).alias(f"__{i}") for i, c in enumerate(overwrite)])
        items = F.array(*[F.col(f"__{i}") for i in range(len(overwrite))])
        parts.append(last.select(qcol(run), F.inline(F.filter(items, lambda x: x.isNotNull()))))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def run_keyed_stream(spark: SparkSession, source: DataFrame, run: str, seq: str, overwrite: list[str], append: list[str],
                     sink_dir: str, time: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run :func:`keyed_updates` to the stream's present end and return all updates. A replayed micro-batch overwrites its own folder."""
    checkpoint = checkpoint or os.path.join(checkpoint_dir(spark), "streams", os.path.basename(sink_dir.rstrip("/")))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))

    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        updates = keyed_updates(source, run, seq, overwrite, append, time)
        query = updates.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(updates.schema).parquet(os.path.join(sink_dir, "batch_id=*"))
