"""Stand-in inputs derived from the driver tables.

The driver tables hold no nulls, duplicates or bad tokens, so the operators that repair those are exercised on views
derived from them.  These builders only shape rows into the schema the operators expect; they do none of the
operators' work.  The same SQL text (``DIRTY_SQL``) runs in Spark and in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.sources.tables import load_table

# Fixed fixture definition (shared verbatim by the Spark side and the oracle side).
DIRTY_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderpriority AS region,
         CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
         CASE WHEN (o_custkey * 7 + o_orderkey * 3) % 10 < 4 THEN 1 ELSE 0 END AS churn
  FROM {orders}
), clean AS (
  SELECT 'C' || lpad(CAST(k AS STRING), 8, '0') AS customer_id,
         CAST(18 + k % 62 AS INT) AS age,
         CASE WHEN k % 13 = 0 THEN NULL ELSE p END AS annual_income,
         CASE WHEN k % 20 = 0 THEN NULL ELSE CAST(c % 120 AS DOUBLE) END AS tenure_months,
         CASE WHEN k % 80 = 5 THEN CAST(250 + k % 150 AS DOUBLE) ELSE CAST(c % 60 AS DOUBLE) END AS monthly_usage_gb,
         CASE WHEN k % 20 < 9 THEN 'basic' WHEN k % 20 < 16 THEN 'standard' ELSE 'premium' END AS segment,
         region,
         CASE WHEN k % 10 = 3 THEN NULL WHEN k % 50 = 0 THEN 'N/A' WHEN k % 50 = 1 THEN 'unknown'
              ELSE CAST(300 + c % 551 AS STRING) END AS credit_score_text,
         CASE WHEN k % 33 = 0 THEN NULL ELSE d END AS signup_date,
         CAST(churn AS DOUBLE) + CAST(k % 5 - 2 AS DOUBLE) / CAST(200 AS DOUBLE) AS leaky_churn_copy,
         CASE WHEN k % 97 = 11 THEN NULL ELSE churn END AS churn,
         CAST(NULL AS DOUBLE) AS all_null_feature,
         'legacy' AS legacy_flag
  FROM base
)
SELECT * FROM clean UNION ALL SELECT * FROM clean WHERE customer_id LIKE '%07'
"""

DIRTY_COLUMNS = ["customer_id", "age", "annual_income", "tenure_months", "monthly_usage_gb", "segment", "region",
                 "credit_score_text", "signup_date", "leaky_churn_copy", "churn", "all_null_feature", "legacy_flag"]
DIRTY_TARGET = "churn"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``dirty`` churn-like view over ``orders`` (planted nulls, bad tokens, duplicates, leak, constants)."""
    orders = load_table(spark, sf_dir, "orders")
    return spark.sql(DIRTY_SQL, orders=orders)


def weblog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log with forwarding headers and user agents, one row per ``events`` row."""
    e = load_table(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id")
    m5, m6, m3 = i % 5, i % 6, i % 3
    xff = (F.when(m5 == 0, F.concat(F.lit("203.0.113."), (i % 250).cast("string"), F.lit(", 10.0.0.1")))
           .when(m5 == 1, F.lit(" 198.51.100.7 ")).otherwise(F.lit("")))
    xri = F.when(m5 == 2, F.lit("192.0.2.9")).otherwise(F.lit(""))
    ua = (F.when(m6 == 0, F.lit("Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0"))
          .when(m6 == 1, F.lit("Mozilla/5.0 (Macintosh; Intel Mac OS X 14_0) Chrome/120.0 Safari/537.36"))
          .when(m6 == 2, F.lit("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Safari/604.1"))
          .when(m6 == 3, F.lit("Mozilla/5.0 (X11; Linux x86_64) Firefox/121.0"))
          .when(m6 == 4, F.lit("Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Safari/537.36"))
          .otherwise(F.lit("curl/8.0")))
    lang = F.when(m3 == 0, F.lit("en-GB,en;q=0.9")).when(m3 == 1, F.lit("fr"))
    return e.select(i.alias("req_id"), xff.alias("x_forwarded_for"), xri.alias("x_real_ip"),
                    ua.alias("user_agent"), lang.alias("accept_language"))


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw usage payloads in three vendor JSON shapes plus empty objects, one row per ``events`` row."""
    e = load_table(spark, sf_dir, "events").select("event_id", "event_type")
    i = F.col("event_id")
    a, b = (i % 97).cast("string"), (i % 31).cast("string")
    m4 = i % 4
    payload = (
        F.when(m4 == 0, F.concat(F.lit('{"usage":{"input_tokens":'), a, F.lit(',"output_tokens":'), b, F.lit("}}")))
        .when(m4 == 1, F.concat(F.lit('{"response":{"usage_metadata":{"prompt_tokens":'), a,
                                F.lit(',"candidates_tokens":'), b, F.lit("}}}")))
        .when(m4 == 2, F.concat(F.lit('{"response":{"token_usage":{"prompt_tokens":'), a,
                                F.lit(',"completion_tokens":'), b, F.lit("}}}")))
        .otherwise(F.lit("{}")))
    return e.select(i.alias("event_id"), F.col("event_type").alias("stage"), payload.alias("payload"))
