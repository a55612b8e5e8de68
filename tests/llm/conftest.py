import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text, lang, source), with extra columns whose names the operators use themselves."""
    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOC_SCHEMA)
        if extra:
            from pyspark.sql import functions as F
            for name in ("node", "kept", "shard", "slot", "band", "t", "k0", "k", "score", "spans", "x", "ids", "n"):
                df = df.withColumn(name, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
