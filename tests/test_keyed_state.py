"""Keyed state by Spark's own stateful operators: no Python call per event or run."""

import os
import uuid

from tablesmith.session import scratch_path
from tablesmith.streaming.state import keyed_updates, run_keyed_stream


def test_updates_of_repeated_events(spark):
    base = scratch_path(spark, f"keyed-{uuid.uuid4().hex}")
    schema = "u long, n long, kind string, v double"
    for rows in ([(1, 5, "e", 1.5), (2, 1, None, float("nan")), (None, 1, "x", 2.0)], [(1, 4, "d", None), (1, 5, "e", 1.5), (2, 2, "b", 0.5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(base, "src"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "src"))
    updates = keyed_updates(src, "u", "n", ["kind"], ["v"])
    plan = updates._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Deduplicate" in plan
    out = run_keyed_stream(spark, src, "u", "n", ["kind"], ["v"], os.path.join(base, "sink")).collect()
    assert sorted(((r.u or 0), r.seq, r.value) for r in out if r.name == "v") == [(0, 1, "2.0"), (1, 5, "1.5"), (2, 2, "0.5")]
    assert {(r.u, r.seq, r.value) for r in out if r.name == "kind"} == {(1, 5, "e"), (None, 1, "x"), (2, 2, "b")}
