"""Secret scan through a trigram inverted index (DataFrame functions only)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablesmith.llm.common import cut

#: Rules in report order: kind, pattern (Java and Python syntax), group whose length counts, its least length.
#: The first three are the base kinds. A longer run of one class may be asked for in the pattern itself; ``assign`` may
#: not, since a match that is too short still uses up its text.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 39),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
)
#: What follows the first line of a private key: all up to its last line, or the lines of base64 where that is missing.
#: Possessive groups are loops in Java's regex; a plain group would recurse once per line of the key.
KEY_BODY = (r"""(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,20}PRIVATE KEY-----"""
            r"""|(?:\s++[A-Za-z0-9+/]{16,}+={0,2}+)*+(?:\s++[A-Za-z0-9+/]{1,15}+={1,2})?)""")
#: The rules of a redaction, in which the key itself goes with its first line.
REDACTED = tuple((kind, pattern + KEY_BODY if kind == "private_key" else pattern, group, least) for kind, pattern, group, least in RULES)
BASE_KINDS = ("assign", "access", "hex")
#: Classes and products of alternatives beyond these sizes count as unknown text.
MOST_CLASS, MOST_STRINGS = 8, 64

Query = frozenset  # of frozensets of trigrams: any of the inner sets, all of its trigrams


def _trigrams(text: str) -> frozenset:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _strings_query(strings: set[str]) -> Query | None:
    """Which trigrams a text with one of ``strings`` must hold; None where one of them is too short to tell."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(_trigrams(s) for s in strings)


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return a if b is None else b
    return frozenset(x | y for x in a for y in b)


def _least(q: Query | None) -> Query | None:
    """Without alternatives that another, weaker one covers."""
    return q if q is None else frozenset(x for x in q if not any(y < x for y in q))


def _walk(items) -> tuple[set[str] | None, Query | None]:
    """(all strings that the sequence can match, or None where unknown; the trigram query that any match fulfils)."""
    run: set[str] | None = {""}
    whole, query = True, None
    for op, arg in items:
        strings, inner = _item(str(op), arg)
        query = _both(query, inner)
        if strings is not None and run is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query = _both(query, _strings_query(run)) if run is not None else query
        whole, run = False, strings if strings is not None else {""}
    if not whole:
        return None, _both(query, _strings_query(run))
    return run, query


def _item(op: str, arg) -> tuple[set[str] | None, Query | None]:
    if op == "LITERAL":
        return {chr(arg).lower()}, None
    if op == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            low, high = value if str(kind) == "RANGE" else (value, value)
            if str(kind) not in ("RANGE", "LITERAL") or high - low > 4 * MOST_CLASS:
                return None, None
            chars |= {chr(c).lower() for c in range(low, high + 1)}
        return (chars, None) if len(chars) <= MOST_CLASS else (None, None)
    if op == "SUBPATTERN":
        return _walk(arg[3])
    if op == "BRANCH":
        found = [_walk(b) for b in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), None
        queries = [_both(q, _strings_query(s)) if s is not None else q for s, q in found]
        return None, None if any(q is None for q in queries) else frozenset().union(*queries)
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        strings, query = _walk(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, None
        if low == 0:
            return None, None
        if low == high and strings is not None and len(strings) ** int(low) <= MOST_STRINGS:
            return reduce(lambda a, b: {x + y for x in a for y in b}, [strings] * int(low)), query
        return None, _both(query, _strings_query(strings)) if strings is not None else query
    if op == "AT":
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Query | None:
    """Boolean trigram query of a regex, on lower-cased text: alternatives of trigrams that must all occur.

    None means that no trigram is mandatory: the rule has to scan every text.
    """
    strings, query = _walk(re._parser.parse(pattern))
    if strings is not None:
        query = _both(query, _strings_query(strings))
    return _least(query)


def _lengths(text: Column, ord_: int, kind: str, pattern: str, group: int) -> Column:
    """Per match of one rule: its number, the length of the text since the last match, its own and its group's length."""
    sizes = lambda xs: F.transform(xs, lambda x: F.length(x))
    p = F.lit(pattern)
    both = F.arrays_zip(sizes(F.split(text, pattern, -1)).alias("gap"), sizes(F.regexp_extract_all(text, p, F.lit(0))).alias("len"),
                        sizes(F.regexp_extract_all(text, p, F.lit(group))).alias("part"))
    return F.filter(F.transform(both, lambda x, i: F.struct(
        F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"),
        x["part"].alias("part"))), lambda x: x["len"].isNotNull())


SPANS = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``k`` (key), ``t`` (text), ``h`` and ``n`` (hash and length of the text)."""
    return (docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
            .withColumn("h", F.xxhash64("t")).withColumn("n", F.length("t")))


def _same(left: str = "", right: str = "s") -> Column:
    return (F.col(f"{left}k").eqNullSafe(F.col(f"{right}k")) & (F.col(f"{left}h") == F.col(f"{right}h"))
            & (F.col(f"{left}n") == F.col(f"{right}n")))


#: Rows of one bitmap: a bitmap of Spark's bitmap functions has 4,096 bytes.
BITMAP_ROWS = 8 * 4096


def index_postings(rows: DataFrame) -> DataFrame:
    """The inverted index of ``rows`` (at: row number from 1, grams): (gram, bucket, bits), a bitmap per trigram and bucket of rows.

    A trigram that every row holds has one bitmap per ``BITMAP_ROWS`` rows, so no posting list is one group.
    """
    return (rows.select(F.explode("grams").alias("gram"), F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
            .groupBy("gram", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))


def answer_queries(postings: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """Rows that fulfil each Boolean trigram query: (at, query).

    In each bucket the bitmaps of an alternative's trigrams are intersected (a trigram without rows there leaves it out), then
    the bitmaps of a query's alternatives are united, and the bits that are left become row numbers.
    """
    clauses = [(q, i, sorted(clause)) for q, query in queries.items() for i, clause in enumerate(sorted(query, key=sorted))]
    needs: dict[str, list] = {}
    for q, i, clause in clauses:
        for gram in clause:
            needs.setdefault(gram, []).append(F.struct(F.lit(q).alias("query"), F.lit(i).alias("clause"), F.lit(len(clause)).alias("all")))
    if not needs:
        return postings.select(F.col("bucket").alias("at"), F.lit(0).alias("query")).limit(0)
    uses = F.create_map(*[x for gram, rows in needs.items() for x in (F.lit(gram), F.array(*rows))])
    asked = postings.select("bucket", "bits", F.inline(F.element_at(uses, F.col("gram"))))
    both = (asked.groupBy("bucket", "query", "clause", "all").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == F.col("all")))
    any_ = both.groupBy("bucket", "query").agg(F.bitmap_or_agg("bits").alias("bits"))
    byte = lambda i: F.substring("bits", i + 1, F.lit(1))
    held = F.filter(F.sequence(F.lit(0), F.lit(BITMAP_ROWS // 8 - 1)), lambda i: byte(i) != F.unhex(F.lit("00")))
    full = any_.select("bucket", "query", F.explode(F.transform(held, lambda i: F.struct(
        i.alias("byte"), F.conv(F.hex(byte(i)), 16, 10).cast("int").alias("value")))).alias("b"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda j: F.getbit(F.col("b.value"), j) == 1)
    rows = full.select("bucket", "query", "b.byte", F.explode(bits).alias("bit"))
    return rows.select(((F.col("bucket") - 1) * BITMAP_ROWS + F.col("byte") * 8 + F.col("bit") + 1).alias("at"), "query")


def secret_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple = RULES) -> tuple[DataFrame, DataFrame]:
    """(keys of all documents, spans of the documents that have any), both by key, hash and length of the text.

    The index holds, for each trigram that some rule needs, bitmaps of the rows it occurs in (:func:`index_postings`). Each
    rule's Boolean query is answered from the bitmaps alone; only the candidates' texts are read again and verified with the
    regex. Rules without mandatory trigrams scan every text in the first pass. Matches are leftmost and not overlapping per rule; those whose
    group is shorter than the rule asks for are dropped. Positions are code points, end exclusive, in array order.
    """
    queries = {kind: trigram_query(pattern) for kind, pattern, *_ in rules}
    grams = sorted({g for q in queries.values() if q for clause in q for g in clause})
    ords = {kind: i for i, (kind, *_) in enumerate(rules)}
    slim = _keyed(docs, text, key)
    ids = ["k", "h", "n"]

    empty = F.array().cast("array<struct<ord:int,kind:string,i:int,gap:int,len:int,part:int>>")
    lengths = lambda some: F.concat(empty, *[F.when(cond, _lengths(F.col("t"), ords[kind], kind, p, group)).otherwise(empty)
                                             for cond, (kind, p, group, _) in some])
    # the lower-cased text is bound to a name of its own, or the optimiser would lower it again for each trigram
    found = F.flatten(F.transform(F.array(F.lower("t")), lambda low: F.filter(
        F.array(*[F.lit(g) for g in grams]).cast("array<string>"), lambda g: F.contains(low, g))))
    first = cut(slim.select(*ids, found.alias("grams"), lengths([(F.col("t").rlike(r[1]), r) for r in rules if queries[r[0]] is None]).alias("scanned"))
                .withColumn("at", F.monotonically_increasing_id() + 1), "secret-scan")

    postings = cut(index_postings(first), "postings")
    hits = answer_queries(postings, {ords[kind]: q for kind, q in queries.items() if q is not None})
    candidates = cut(hits.join(first.select("at", *ids), "at").groupBy(*[F.col(c).alias(f"c{c}") for c in ids])
                     .agg(F.collect_set("query").alias("rules")), "candidates")
    checked = slim.join(candidates, _same(right="c")).select(*ids, F.explode(lengths(
        [(F.array_contains("rules", ords[r[0]]), r) for r in rules if queries[r[0]] is not None])).alias("m"))

    matches = checked.unionByName(first.select(*ids, F.explode("scanned").alias("m"))).select(*ids, "m.*").distinct()
    so_far = W.partitionBy(*ids, "ord").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    least = F.element_at(F.create_map(*[F.lit(x) for kind, _, _, n in rules for x in (kind, n)]), F.col("kind"))
    spans = (matches.withColumn("end", end).filter(F.col("part") >= least)
             .select(*ids, F.struct((F.col("end") - F.col("len")).alias("start"), "ord", "kind", "end").alias("s"))
             .groupBy(*[F.col(c).alias(f"s{c}") for c in ids]).agg(F.array_sort(F.collect_list("s")).alias("spans")))
    return first.select(*ids), cut(spans, "secret-spans")


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple = RULES) -> DataFrame:
    """Spans of every rule in every whole text: one row per document with ``spans``, an array of struct(start, ord, kind, end).

    Nulls: a null text is empty, a null key is kept. Rows with equal key and text get equal spans, each its own row. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    keys, spans = secret_spans(docs, text, key, rules)
    return (keys.join(spans, _same(), "left")
            .select(F.col("k").alias(key), F.coalesce("spans", F.array().cast(SPANS)).alias("spans")))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[secret]", rules: tuple = REDACTED) -> DataFrame:
    """All rows and columns of ``docs``, with ``mark`` in place of each secret (overlapping ones together); a null text stays null."""
    _, spans = secret_spans(docs, text, key, rules)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    body = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(body, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", begin, step, lambda acc: F.concat(acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))))
    spans = spans.select(*[F.col(f"s{c}").alias(f"__s{c}") for c in "khn"], F.col("spans").alias("__spans"))
    t = F.coalesce(body, F.lit(""))
    match = F.col(key).eqNullSafe(F.col("__sk")) & (F.xxhash64(t) == F.col("__sh")) & (F.length(t) == F.col("__sn"))
    return docs.join(spans, match, "left").select(*[
        (F.when(F.col("__spans").isNull(), body).otherwise(clean).alias(text) if c == text else F.col(c)) for c in docs.columns])


def join_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def oracle() -> str:
    """DuckDB SQL for the query over ``documents``: every rule scans every text."""
    parts = []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"SELECT r, doc_id, {i} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, {p}, 0) AS m, "
                     f"regexp_extract_all(text, {p}, {group}) AS g, string_split_regex(text, {p}) AS s FROM t")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
a AS ({' UNION ALL '.join(parts)}),
b AS (SELECT r, ord, kind, least, m, g, s, unnest(range(1, len(m) + 1)) AS i FROM a),
c AS (SELECT r, ord, kind, least, length(g[i]) AS part, length(m[i]) AS n,
  sum(length(s[i]) + length(m[i])) OVER (PARTITION BY r, ord ORDER BY i) AS stop FROM b),
d AS (SELECT r, ord, kind, CAST(stop - n AS BIGINT) AS start, kind || ':' || CAST(CAST(stop - n AS BIGINT) AS VARCHAR) || ':' ||
  CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span FROM c WHERE part >= least),
e AS (SELECT r, string_agg(span, ',' ORDER BY start, ord) AS spans,
  string_agg(span, ',' ORDER BY start, ord) FILTER (kind IN ({base})) AS base,
  {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)} FROM d GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM t LEFT JOIN e USING (r)"""
