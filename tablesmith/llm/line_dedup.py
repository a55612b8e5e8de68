"""Line dedup: lines that many documents share are dropped from every document (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import cut

#: White space that is stripped from both ends of a line before it is compared.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_HASH = "struct<a:bigint,b:bigint>"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _key_hashes(text: Column, min_chars: int) -> Column:
    """Per line of ``text`` two 64-bit hashes of its normalised form, null where that is shorter than ``min_chars``."""
    def one(line: Column) -> Column:
        pair = F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))
        return F.when(F.char_length(line) >= min_chars, pair)

    lines = F.transform(F.split(lower_ascii(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(lines, one).cast(f"array<{_HASH}>")


def frequent_lines(hashed: DataFrame, min_docs: int) -> DataFrame:
    """Hashes (columns ``a``, ``b``) of the lines found in at least ``min_docs`` rows of ``hashed``.

    A line counts once per row, so the count is a plain sum with map-side combine: a line that a third of all rows share
    is one row per task.
    """
    once = hashed.select(F.explode(F.array_distinct("lines")).alias("x")).filter("x IS NOT NULL")
    return once.groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("a", "b")


def drop_frequent_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, min_chars: int = 1,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` without the lines that at least ``min_docs`` rows share.

    Lines are split at ``\\n``; two lines are the same if they are equal after stripping white space at both ends and
    lower-casing A-Z. A normalised line shorter than ``min_chars`` code points is never dropped. The other lines are put
    together in their order. Columns: ``key``, the ``keep`` columns, ``text`` (what is left), ``n_lines`` (before) and
    ``n_dropped``.

    The lines' hashes (128 bits) are written once; the count of rows per hash and the places of the dropped lines come
    from that table. A text meets only the places of its own dropped lines: the runs between them are sliced out
    and joined. Spark broadcasts the frequent hashes or the places where they are small, and otherwise joins by hash (a
    hot line's rows need no group, so a skewed partition can be split) and by row key.

    Nulls: a null or empty text is one empty line; a null key is a key. Rows with equal key and text are
    documents of their own and each is counted and returned. A text whose lines all go becomes empty. Columns that are
    not in ``keep`` are ignored, whatever their names. An empty table gives an empty result.
    """
    slim = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"),
                       *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    slim = slim.withColumn("h", F.xxhash64("t")).withColumn("n", F.length("t"))
    hashed = cut(slim.select("k", "h", "n", _key_hashes(F.col("t"), min_chars).alias("lines")), "line-hashes")
    frequent = cut(frequent_lines(hashed, min_docs), "frequent-lines")

    lines = hashed.select("k", "h", "n", F.posexplode("lines").alias("i", "x")).filter("x IS NOT NULL")
    hit = lines.select("k", "h", "n", "i", "x.a", "x.b").join(frequent, ["a", "b"], "left_semi")
    places = hit.groupBy(F.col("k").alias("pk"), F.col("h").alias("ph"), F.col("n").alias("pn")).agg(F.collect_set("i").alias("at"))
    places = cut(places.withColumn("at", F.array_sort("at")), "dropped-lines")

    same = F.col("k").eqNullSafe(F.col("pk")) & (F.col("h") == F.col("ph")) & (F.col("n") == F.col("pn"))
    parts = F.split("t", "\n", -1)
    ends = F.concat("at", F.array("n_lines"))
    runs = F.transform(ends, lambda end, j: F.slice(
        "parts", F.when(j == 0, 1).otherwise(F.element_at(ends, F.greatest(j, F.lit(1))) + 2),
        F.when(j == 0, end).otherwise(end - F.element_at(ends, F.greatest(j, F.lit(1))) - 1)))
    joined = (slim.join(places, same, "left").withColumn("parts", parts).withColumn("n_lines", F.size("parts"))
              .withColumn("left", F.when(F.col("at").isNull(), F.col("t")).otherwise(F.array_join(F.flatten(runs), "\n"))))
    return joined.select(F.col("k").alias(key), *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("left").alias(text),
                         F.col("n_lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"))


def oracle() -> str:
    """DuckDB SQL for the query over ``documents``."""
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
k AS (SELECT r, i, line, translate(trim(line, {blanks}), '{UPPER}', '{LOWER}') AS key FROM u),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM f)) AS n_dropped,
  string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM f)) AS kept FROM k GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM t JOIN g USING (r)"""
