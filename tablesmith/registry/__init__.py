"""Registered checks: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator, and for most of them an
equivalent DuckDB SQL text over the driver tables (the correctness oracle).

Oracle texts are independent SQL; the ``dirty``/``weblog``/``usage_raw`` inputs are spelled out as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from tablesmith.functions.exprs import DATETIME_FORMATS, INF_PATTERN, NUMBER_PATTERN
from tablesmith.sources.fixtures import DIRTY_SQL

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# --- DuckDB-side fixtures (same content as tablesmith.sources.fixtures) -----------------------------------------

FIXTURE_CTES = {
    "dirty": "(" + DIRTY_SQL.format(orders="orders") + ")",
    "weblog": """(SELECT event_id AS req_id,
  CASE event_id % 5 WHEN 0 THEN '203.0.113.' || CAST(event_id % 250 AS STRING) || ', 10.0.0.1'
       WHEN 1 THEN ' 198.51.100.7 ' ELSE '' END AS x_forwarded_for,
  CASE event_id % 5 WHEN 2 THEN '192.0.2.9' ELSE '' END AS x_real_ip,
  CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0'
       WHEN 1 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Chrome/120.0 Safari/537.36'
       WHEN 2 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Safari/604.1'
       WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0'
       WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Safari/537.36'
       ELSE 'curl/8.0' END AS user_agent,
  CASE event_id % 3 WHEN 0 THEN 'en-GB,en;q=0.9' WHEN 1 THEN 'fr' ELSE NULL END AS accept_language
FROM events)""",
    "usage_raw": """(SELECT event_id, event_type AS stage,
  CASE event_id % 4
    WHEN 0 THEN '{"usage":{"input_tokens":' || CAST(event_id % 97 AS STRING) || ',"output_tokens":' || CAST(event_id % 31 AS STRING) || '}}'
    WHEN 1 THEN '{"response":{"usage_metadata":{"prompt_tokens":' || CAST(event_id % 97 AS STRING) || ',"candidates_tokens":' || CAST(event_id % 31 AS STRING) || '}}}'
    WHEN 2 THEN '{"response":{"token_usage":{"prompt_tokens":' || CAST(event_id % 97 AS STRING) || ',"completion_tokens":' || CAST(event_id % 31 AS STRING) || '}}}'
    ELSE '{}' END AS payload
FROM events)""",
}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with the fixture CTEs; merges with a leading ``WITH`` of the body."""
    ctes = ",\n".join(f"{n} AS {FIXTURE_CTES[n]}" for n in names)
    stripped = body.lstrip()
    if not names:
        return body
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


# --- DuckDB expression helpers ----------------------------------------------------------------------------------

_DUCK_FORMATS = {
    "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S", "yyyy-MM-dd'T'HH:mm:ss": "%Y-%m-%dT%H:%M:%S",
    "yyyy-MM-dd HH:mm": "%Y-%m-%d %H:%M", "yyyy-MM-dd": "%Y-%m-%d", "yyyy/MM/dd": "%Y/%m/%d",
    "M/d/yyyy": "%m/%d/%Y", "d/M/yyyy": "%d/%m/%Y", "yyyyMMdd": "%Y%m%d", "yyyy": "%Y",
}


def duck_num(col: str, kind: str) -> str:
    """SQL for the engine's number coercion (kind: 'num' for numeric columns, 'str' for text, 'other')."""
    if kind == "num":
        return f"CAST({col} AS DOUBLE)"
    if kind == "str":
        return (f"CASE WHEN regexp_matches({col}, '{NUMBER_PATTERN}') OR regexp_matches({col}, '{INF_PATTERN}') "
                f"THEN TRY_CAST(trim({col}) AS DOUBLE) END")
    return "CAST(NULL AS DOUBLE)"


def duck_ts(col: str) -> str:
    parts = [f"try_strptime(trim({col}), '{_DUCK_FORMATS[f]}')" for f in DATETIME_FORMATS]
    return "coalesce(" + ", ".join(parts) + ")"


def union_all(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)
