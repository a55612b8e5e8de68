"""Bundle round trip, batch scoring keeps every row, stream scoring equals batch scoring."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_batch_equals_stream(spark):
    batch = E.queries()["score_batch"](spark, SF_SMALL)
    stream = E.queries()["score_stream"](spark, SF_SMALL)
    assert batch.count() == 1515
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_bundle_keys(spark):
    row = E.queries()["bundle_roundtrip"](spark, SF_SMALL).collect()[0]
    assert row["model_id"] == "RandomForest" and row["problem_type"] == "classification"
    assert row["labels"] == "0,1"


def test_predictions_are_labels(spark):
    out = E.queries()["score_batch"](spark, SF_SMALL)
    assert {tuple(r) for r in out.select("scored", "agrees").distinct().collect()} == {(True, True)}


def test_leakage_loop_drops_the_planted_copy(spark):
    from tablesmith.plans.run import run
    from tablesmith.sources.fixtures import dirty
    r = run(spark, dirty(spark, SF_SMALL), "churn", models=["LogisticRegression"], tune=False)
    try:
        assert r.dropped_for_leakage == ["leaky_churn_copy"]
        assert r.attempts == 2
        assert "leaky_churn_copy" not in r.features
        import os
        import uuid
        from tablesmith.operators.reporting import build_report, write_report
        from tablesmith.session import checkpoint_dir
        from tablesmith.sources.fixtures import usage_raw
        from tablesmith.operators.reporting import usage_table
        rep = build_report(spark, dirty(spark, SF_SMALL), r, usage_table(usage_raw(spark, SF_SMALL)))
        path = os.path.join(checkpoint_dir(spark), f"report-{uuid.uuid4().hex}")
        write_report(rep, path)
        lines = [x[0] for x in spark.read.text(path).collect()]
        assert lines[0] == "- **Problem Type**: classification"
        assert any(x.startswith("| LogisticRegression | accuracy |") for x in lines)
        assert any(x.startswith("| **Total** |") for x in lines)
    finally:
        r.release()


def test_foreach_batch_stream_runner(spark):
    import os
    import uuid

    from tablesmith.operators.training import feature_table, fit_final_model
    from tablesmith.plans.prep_fit import apply_prep, fit_prep
    from tablesmith.session import checkpoint_dir
    from tablesmith.sources.bundle import load_bundle, save_bundle
    from tablesmith.sources.fixtures import dirty
    from tablesmith.streaming.score import run_scoring_stream

    base = os.path.join(checkpoint_dir(spark), f"stream-runner-{uuid.uuid4().hex}")
    d = dirty(spark, SF_SMALL).drop("leaky_churn_copy")
    spec = fit_prep(d, "churn")
    ft = feature_table(apply_prep(d, spec), "churn", "classification")
    save_bundle(spark, fit_final_model(ft, "LogisticRegression"), spec, os.path.join(base, "bundle"))
    bundle = load_bundle(spark, os.path.join(base, "bundle"))
    d.write.parquet(os.path.join(base, "src"))
    q = run_scoring_stream(spark, bundle, os.path.join(base, "src"), d.schema, os.path.join(base, "sink"),
                           checkpoint=os.path.join(base, "ckpt"))
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "sink"))
    assert out.count() == d.count()
    assert {r[0] for r in out.select("prediction").distinct().collect()} <= {0, 1}
    ft.release()
