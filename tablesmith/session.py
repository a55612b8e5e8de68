"""Session helpers: build a session, find the shared checkpoint folder, cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "tablesmith", shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the engine defaults (UTC, AQE, no UI)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Only a local session without that setting (tests) gets a fresh scratch folder; on a cluster
    a missing setting is an error, since executors cannot see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="tablesmith-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_scratch: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for tables an operator writes to cut lineage."""
    path = os.path.join(checkpoint_dir(spark), "tables", name)
    _scratch.add(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that this process wrote through :func:`scratch_path`; frames read from them end with it. Returns how
    many there were. A long session calls this between runs whose results it has stored elsewhere."""
    jvm, paths = spark._jvm, list(_scratch)
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _scratch.discard(p)
    return len(paths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss; never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def persist(df: DataFrame) -> DataFrame:
    """Cache a reused intermediate in memory with disk spill; recomputable from lineage on executor loss."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
