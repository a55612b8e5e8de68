"""Quality rules with thresholds learned per language and source from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tablesmith.llm.common import cut, steps, word_codes

#: Ratios the rules look at: what one event of a text is measured against (its words or its lines), and how many events of a
#: text of the group's median size lie at least and at most between the upper quartile and the limit. So a group of long
#: texts gets tighter limits than one of short texts, and no limit is a number of the ratio's own unit.
RULES = {
    "symbols_per_word": ("words", 1, 3),
    "chars_per_word": ("words", 25, 25),
    "dup_line_share": ("lines", 1, 2),
    "repeat_word_share": ("words", 5, 30),
}
#: Between the two limits a group's own tail decides: this quantile of its sketch and a relative margin.
TAIL, MARGIN = 0.98, 1.0
#: Rules with a lower limit as well (low shares are never a fault).
BOTH_SIDES = ("chars_per_word",)
#: A limit lies at least this many interquartile ranges above the upper quartile.
SPREADS = 4.0
#: Relative error of a sketch's quantiles: bin i holds values in (g^(i-1), g^i] with g = (1 + e) / (1 - e).
SKETCH_ERROR = 0.01
#: Groups with fewer texts take the thresholds of their language, then of the whole corpus.
MIN_GROUP = 50
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

BASE_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _repeated(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words per text that lie in a 5-word window found at least twice in that text."""
    n = len(codes)
    out = np.zeros(len(counts), np.int64)
    if n < WINDOW:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(owner[:n - WINDOW + 1] == owner[WINDOW - 1:])
    mix = owner[first].astype(np.uint64)
    for k in range(WINDOW):
        mix = (mix ^ codes[first + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    order = np.argsort(mix, kind="stable")
    same = mix[order[1:]] == mix[order[:-1]]
    lead, follow = first[order[:-1]], first[order[1:]]
    # equal hashes are compared word by word, so a collision cannot count
    same &= owner[lead] == owner[follow]
    hits = np.flatnonzero(same)
    for k in range(WINDOW):
        hits = hits[codes[lead[hits] + k] == codes[follow[hits] + k]]
    covered = np.zeros(n, bool)
    starts = np.concatenate([lead[hits], follow[hits]])
    for k in range(WINDOW):
        covered[starts + k] = True
    return np.bincount(owner[covered], minlength=len(counts)).astype(np.int64)


def _dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    if "\n" not in text:
        return 0, int(bool(text.encode("utf-8", "surrogatepass").split()))
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.split()]
    return len(lines) - len(set(lines)), len(lines)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base figures of each text (null: no words)."""
    texts = pc.fill_null(texts, "")
    codes, words, counts = word_codes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    lines = np.array([_dup_lines(t) for t in texts.to_pylist()], np.int64).reshape(-1, 2)
    return {
        "n_words": counts,
        "word_chars": np.bincount(owner, weights=chars[codes], minlength=len(texts)).astype(np.int64),
        "n_symbols": pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": lines[:, 0], "n_lines": lines[:, 1],
        "n_repeat_words": _repeated(codes, counts),
    }


def text_figures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the ``keep`` columns (as ``k0``, ``k1``, ...) and the base figures of its whole text."""
    slim = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    fields = [f.simpleString() for f in slim.schema.fields[1:]]
    schema = ", ".join([f.replace(":", " ", 1) for f in fields] + [f"{c} long" for c in BASE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                got = base_counts(part.column(0))
                yield pa.RecordBatch.from_arrays(part.columns[1:] + [pa.array(got[c]) for c in BASE_FIELDS],
                                                 part.schema.names[1:] + list(BASE_FIELDS))

    return slim.mapInArrow(run, schema)


def ratios() -> dict:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {"symbols_per_word": F.col("n_symbols") / words, "chars_per_word": F.col("word_chars") / words,
            "dup_line_share": F.col("n_dup_lines") / lines, "repeat_word_share": F.col("n_repeat_words") / words}


def unit_sizes() -> dict:
    """What one event adds to a text's ratio, by the kind of its denominator."""
    return {"words": F.lit(1.0) / F.greatest(F.col("n_words"), F.lit(1)), "lines": F.lit(1.0) / F.greatest(F.col("n_lines"), F.lit(1))}


def sketches(figures: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Log-bin quantile sketches of every rule's ratio and of both unit sizes: rows (groups, rule, bin, n).

    Sketches merge by adding the counts of equal bins, so partial sums per task are combined in a plain ``groupBy``
    and a group of any size costs one row per bin.
    """
    g = np.log((1 + SKETCH_ERROR) / (1 - SKETCH_ERROR))
    bins = {r: F.when(v > 0, F.ceil(F.log(v) / F.lit(float(g)))).otherwise(F.lit(-(1 << 30))).cast("int")
            for r, v in (ratios() | unit_sizes()).items()}
    rows = figures.select(*groups, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), b.alias("bin"))
                                                       for r, b in bins.items()])).alias("x"))
    return rows.groupBy(*groups, "x.rule", "x.bin").agg(F.count(F.lit(1)).alias("n"))


#: Columns of the limits: the highest ratio of each rule, and the lowest one of those with two sides.
LIMITS = tuple(f"most_{r}" for r in RULES) + tuple(f"least_{r}" for r in BOTH_SIDES)


def sketch_thresholds(sketch: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Limits per group and rule, the group's number of texts, and per rule what set its upper limit (``by_<rule>``).

    All comes from the group's sketches. The upper limit is its ``TAIL`` quantile plus ``MARGIN`` (``tail``), held between
    two distances above the upper quartile: ``SPREADS`` interquartile ranges (``range``) or, where these are smaller, the rule's
    least and most events of a text of median size (``events``). The lower limit is the larger distance below the lower quartile.
    """
    g = (1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)
    key = [*groups, "rule"]
    upto = W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy(*key)))
    value = F.when(F.col("bin") == -(1 << 30), F.lit(0.0)).otherwise(F.pow(F.lit(g), F.col("bin")) * 2 / (1 + g))
    quantile = {q: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * p), value)) for q, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("tail", TAIL))}
    rows = ranked.groupBy(*key).agg(*[x.alias(c) for c, x in quantile.items()], F.max("all").alias("texts"))
    of = lambda r: F.max(F.when(F.col("rule") == r, F.struct(*quantile)))
    wide = rows.groupBy(*groups).agg(F.max("texts").alias("texts"), *[of(r).alias(r) for r in (*RULES, *unit_sizes())])
    out = []
    for r, (unit, few, many) in RULES.items():
        span, one = SPREADS * (F.col(f"{r}.q3") - F.col(f"{r}.q1")), F.col(f"{unit}.q2")
        low, high = (F.col(f"{r}.q3") + F.greatest(span, one * events) for events in (few, many))
        tail = F.col(f"{r}.tail") * (1 + MARGIN)
        out += [F.least(high, F.greatest(low, tail)).alias(f"most_{r}"),
                F.when((low < tail) & (tail < high), "tail").when(span >= one * F.when(tail >= high, many).otherwise(few), "range")
                .otherwise("events").alias(f"by_{r}")]
        if r in BOTH_SIDES:
            out.append((F.col(f"{r}.q1") - F.greatest(span, one * many)).alias(f"least_{r}"))
    return wide.select(*groups, "texts", *out)


def learned_limits(figures: DataFrame, groups: tuple[str, str]) -> DataFrame:
    """Limits of every (language, source) among ``figures`` that pass the base test, with the texts and origins of its own sketch.

    Groups under ``MIN_GROUP`` texts take the limits of their language's merged sketch, those of a small language the corpus's.
    """
    kl, ks = groups
    fine = cut(sketches(figures.filter(~F.col("base_failed")), groups), "rule-sketch")
    by_lang = fine.groupBy(kl, "rule", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    own = sketch_thresholds(fine, groups)
    wide = sketch_thresholds(by_lang, (kl,)).select(F.col(kl).alias("__l"), F.col("texts").alias("__tl"),
                                                    *[F.col(c).alias(f"__l_{c}") for c in LIMITS])
    whole = sketch_thresholds(by_all.withColumn("g", F.lit(0)), ("g",)).select(
        *[F.col(c).alias(f"__a_{c}") for c in LIMITS]).first()
    limits = own.join(wide, F.col(kl).eqNullSafe(F.col("__l")))
    for c in LIMITS:
        limits = limits.withColumn(c, F.when(F.col("texts") >= MIN_GROUP, F.col(c))
                                   .when(F.col("__tl") >= MIN_GROUP, F.col(f"__l_{c}"))
                                   .otherwise(F.lit(whole[f"__a_{c}"] if whole else None)))
    return cut(limits.select(F.col(kl).alias("__lang"), F.col(ks).alias("__source"), "texts", *LIMITS, *[f"by_{r}" for r in RULES]), "rule-limits")


def judged_figures(docs: DataFrame, text: str, lang: str, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The base figures of every document with ``base_failed``, written once; language and source are the last two keys."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return cut(text_figures(docs, text, (*keep, lang, source)).withColumn("base_failed", failed), "rule-figures")


def adaptive_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
                    keep: tuple[str, ...] = ("doc_id",), reasons: bool = False) -> DataFrame:
    """Judge every document: base figures, ``base_failed`` and ``kept``; with ``reasons`` also ``failed_rules``.

    A document fails a rule when its ratio is beyond a limit learned for its language and source. The limits come
    from quantile sketches of all documents that pass the fixed base test; small groups use the merged sketch of their
    language or of the corpus. The thresholds are joined to the documents by language and source.

    Nulls: a null text has no words (it fails the base test); null language or source is a group of its own. Extra
    columns are ignored. Equal rows get equal verdicts. An empty table gives an empty result.
    """
    figures = judged_figures(docs, text, lang, source, keep)
    ids = [f"k{i}" for i in range(len(keep))]
    kl, ks = f"k{len(keep)}", f"k{len(keep) + 1}"
    limits = learned_limits(figures, (kl, ks)).select("__lang", "__source", *LIMITS)
    joined = figures.join(limits, F.col(kl).eqNullSafe(F.col("__lang")) & F.col(ks).eqNullSafe(F.col("__source")), "left")
    fails = {r: F.coalesce(value > F.col(f"most_{r}"), F.lit(False)) for r, value in ratios().items()}
    for r in BOTH_SIDES:
        fails[r] = fails[r] | F.coalesce(ratios()[r] < F.col(f"least_{r}"), F.lit(False))
    named = F.filter(F.array(*[F.when(~F.col("base_failed") & x, F.lit(r)) for r, x in fails.items()]), lambda x: x.isNotNull())
    passed = ~F.col("base_failed")
    for x in fails.values():
        passed = passed & ~x
    return joined.select(*[F.col(i).alias(c) for i, c in zip(ids, keep)], *[c for c in BASE_FIELDS], "base_failed",
                         passed.alias("kept"), *([named.alias("failed_rules")] if reasons else []))


def rejections(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents that each adaptive rule rejects after the base test: (rule, documents); one may fail several rules."""
    judged = adaptive_filter(docs, text, lang, source, (), reasons=True)
    rules = docs.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    counts = judged.select(F.explode("failed_rules").alias("r")).groupBy("r").count()
    return rules.join(counts, F.col("rule") == F.col("r"), "left").select("rule", F.coalesce("count", F.lit(0)).alias("documents"))


def limit_origins(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """What set the upper limits of the groups with ``MIN_GROUP`` texts or more: (rule, origin, groups), see :func:`sketch_thresholds`."""
    limits = learned_limits(judged_figures(docs, text, lang, source), ("k0", "k1")).filter(F.col("texts") >= MIN_GROUP)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"by_{r}").alias("origin")) for r in RULES]))
    return limits.select(each.alias("x")).groupBy("x.rule", "x.origin").agg(F.count(F.lit(1)).alias("groups"))
