"""CSV reading with NA tokens and type inference; catalog union; run report lookup validation."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tablesmith.operators.reporting import lookup_run
from tablesmith.session import checkpoint_dir
from tablesmith.sources.catalog import add_missing
from tablesmith.sources.csv import load_csv


def test_csv_tokens_and_types(spark):
    path = os.path.join(checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    rows = [("1", "1.5", "true", "N/A", "2022-01-01"), ("2", "NA", "false", "x", "2022-01-02"),
            ("", "3e2", "TRUE", "null", "")]
    spark.createDataFrame(rows, "a string, b string, c string, d string, e string").coalesce(1) \
        .write.option("header", True).csv(path)
    df = load_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string"}
    assert df.where(F.col("b").isNull()).count() == 1
    assert df.where(F.col("d").isNull()).count() == 2


def test_catalog_adds_only_missing(spark):
    cat = spark.createDataFrame([("a", "p/a", "y")], "id string, path string, target_column string")
    dflt = spark.createDataFrame([("a", "other"), ("synthetic", "p/s")], "id string, path string")
    out = {r["id"]: r["path"] for r in add_missing(cat, dflt).collect()}
    assert out == {"a": "p/a", "synthetic": "p/s"}


def test_lookup_rejects_bad_ids(spark):
    with pytest.raises(ValueError):
        lookup_run(spark, "/nonexistent", "../etc")


def test_streaming_append_log(spark):
    from tablesmith.sources.logs import append_records_stream, read_records
    base = os.path.join(checkpoint_dir(spark), f"log-stream-{uuid.uuid4().hex}")
    rows = spark.createDataFrame([(i, f"10.0.0.{i}") for i in range(20)], "req_id long, ip string")
    rows.write.parquet(os.path.join(base, "src"))
    src = spark.readStream.schema(rows.schema).parquet(os.path.join(base, "src"))
    q = append_records_stream(src, os.path.join(base, "log"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    assert read_records(spark, os.path.join(base, "log"), rows.schema).count() == 20


def test_text_shaping(spark):
    from tablesmith.functions.text import feature_badges, redact_paths, score_cell
    df = spark.createDataFrame([("age, income ,tenure", "saved to /tmp/runs/abc/report.md ok", 0.91234, 0.01)],
                               "f string, msg string, m double, s double")
    r = df.select(feature_badges(F.col("f")).alias("b"), redact_paths(F.col("msg")).alias("r"),
                  score_cell(F.col("m"), F.col("s")).alias("c")).collect()[0]
    assert r["b"] == ["age", "income", "tenure"]
    assert r["r"] == "saved to report.md ok"
    assert r["c"] == "0.9123 ± 0.0100"
