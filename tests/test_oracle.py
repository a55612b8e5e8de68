"""Every registered query with an oracle equals its DuckDB SQL (row multiset, rounded floats) on sf0.001."""

import math

import duckdb
import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402
from tablesmith.sources.tables import TABLES

# minutes of training each, also on the smallest tables: tools/oracle_check.py runs them
SLOW = {"automl_run", "battery", "battery_summary", "model_rf", "score_stream", "tune"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - SLOW))
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() == 13
    assert df.columns == ["column_name", "dtype", "missing_fraction", "cardinality"]
