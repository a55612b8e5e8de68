"""Column profiling: shape, missingness, cardinality, semantic dtypes, problem type, class balance,
correlation flags and IQR outliers.

Cost shape: one global aggregate (missingness + dtype shares, map-side partial aggregation, one row out) and one
value histogram (``unpivot`` then ``groupBy(column_name)`` with a distinct count; Spark plans it as a shuffle on
``(column_name, value)`` so a high-cardinality column spreads over all reducers and a hot value collapses map-side).
Everything returned is a lazy DataFrame unless the docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.exprs import (
    INTEGRAL_TYPES, NESTED_TYPES, ROUND_DIGITS, dtype_of, finite, guarded_corr, is_datetime, is_missing, is_numeric,
    is_string, qcol, rnd, to_num, to_ts, unpivot_as_text,
)
from tablesmith.operators.aggs import collect_agg
from tablesmith.operators.quantiles import quantiles

# Fixed rule constants of problem-type detection.
CLASSIFICATION_MAX_UNIQUE = 20
CLASSIFICATION_MAX_UNIQUE_FRACTION = 0.05
DATETIME_SHARE = 0.9
CORRELATION_THRESHOLD = 0.9
CORR_CHUNK = 60  # pair expressions per aggregate job (wide aggregates are compile bound)


def _long(row_df: DataFrame, items: list[Column]) -> DataFrame:
    """Explode an array of same-shaped structs from a one-row aggregate into rows."""
    return row_df.select(F.inline(F.array(*items)))


def profile_shape(df: DataFrame) -> DataFrame:
    """A1: ``(n_rows LONG, n_columns INT)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("int").alias("n_columns"))


def _static_dtype(dt: T.DataType) -> str | None:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_datetime(dt):
        return "datetime64"
    if isinstance(dt, INTEGRAL_TYPES):
        return "int64"
    if is_numeric(dt):
        return "float64"
    if isinstance(dt, NESTED_TYPES):
        return "object"
    return None


STATS_CHUNK = 50  # columns per aggregate scan of column_stats (wide tables stay within codegen limits)


def column_stats(df: DataFrame) -> DataFrame:
    """One aggregate pass (per 50 columns): per column ``(column_name, position, n_rows, n_missing, n_non_null,
    n_number, n_datetime, dtype)``.  ``n_number``/``n_datetime`` count non-null text values parseable as number /
    datetime."""
    fields = list(enumerate(df.schema.fields))
    parts = [_column_stats_chunk(df, fields[s:s + STATS_CHUNK]) for s in range(0, len(fields), STATS_CHUNK)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _column_stats_chunk(df: DataFrame, fields: list) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in fields:
        c = qcol(f.name)
        aggs.append(F.count_if(is_missing(c, f.dataType)).alias(f"m{i}"))
        if is_string(f.dataType):
            aggs.append(F.count(c).alias(f"nn{i}"))
            aggs.append(F.count(to_num(c, f.dataType)).alias(f"num{i}"))
            aggs.append(F.count(to_ts(c, f.dataType)).alias(f"dt{i}"))
    row = df.agg(*aggs)
    items = []
    for i, f in fields:
        n, m = F.col("_n"), F.col(f"m{i}")
        static = _static_dtype(f.dataType)
        if static is not None or not is_string(f.dataType):
            nn, num, dtc = n - m, F.lit(None).cast("long"), F.lit(None).cast("long")
            label = F.lit(static or "object")
        else:
            nn, num, dtc = F.col(f"nn{i}"), F.col(f"num{i}"), F.col(f"dt{i}")
            share = num / nn
            label = (F.when(nn == 0, F.lit("object"))
                     .when((share > 0) & (share < 1), F.lit("mixed_numeric"))
                     .when(share == 1, F.lit("numeric_string"))
                     .when(dtc / nn >= DATETIME_SHARE, F.lit("datetime_string"))
                     .otherwise(F.lit("object")))
        items.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                              n.alias("n_rows"), m.alias("n_missing"), nn.alias("n_non_null"),
                              num.alias("n_number"), dtc.alias("n_datetime"), label.alias("dtype")))
    return _long(row, items)


def missingness(df: DataFrame) -> DataFrame:
    """A2: ``(column_name, missing_fraction)``; 0.0 for an empty table."""
    s = column_stats(df)
    frac = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(F.col("n_missing") / F.col("n_rows"))
    return s.select("column_name", frac.alias("missing_fraction"))


def infer_dtypes(df: DataFrame) -> DataFrame:
    """A4: ``(column_name, dtype)`` with the semantic labels bool / datetime64 / int64 / float64 / mixed_numeric /
    numeric_string / datetime_string / object."""
    return column_stats(df).select("column_name", "dtype")


def cardinality(df: DataFrame, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """A3: ``(column_name, cardinality LONG)`` distinct non-null values per column.

    One unpivot to ``(column_name, s, i, d)``: integers, booleans and datetimes as a long, floating-point numbers as
    a double (-0.0 equals 0.0), decimals and everything else as text; the distinct count then runs over ``(column_name, value)``
    pairs (hash partitioned, so a high-cardinality column spreads over all reducers).  Columns without any value
    come back with 0 through the caller's left join."""
    structs = []
    for f in df.schema.fields:
        c = qcol(f.name)
        s_, i_, d_ = (F.lit(None).cast(t) for t in ("string", "long", "double"))
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
            i_ = c.cast("long")
        elif is_datetime(f.dataType):
            i_ = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            d_ = c.cast("double")
        else:
            s_ = F.to_json(c) if isinstance(f.dataType, NESTED_TYPES) else c.cast("string")
        structs.append(F.struct(F.lit(f.name).alias("column_name"), s_.alias("s"), i_.alias("i"), d_.alias("d")))
    long = df.select(F.inline(F.array(*structs))).where(F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("d").cast("string")).isNotNull())
    v = F.struct("s", "i", "d")
    if approx:
        agg = F.approx_count_distinct(F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("d").cast("string")), rsd)
    else:
        agg = F.count_distinct(v)
    counted = long.groupBy("column_name").agg(agg.alias("cardinality"))
    # every column appears, all-null ones with 0 (names from a one-row aggregate of the same table)
    names = df.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.array(*[F.lit(c) for c in df.columns]))
                                                          .alias("column_name"))
    return names.join(F.broadcast(counted), "column_name", "left").select(
        "column_name", F.coalesce(F.col("cardinality"), F.lit(0).cast("long")).alias("cardinality"))


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, value STRING, n LONG)`` non-null value counts for the given columns."""
    long = unpivot_as_text(df, columns).where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """A9 (columns part): ``(column_name, dtype, missing_fraction, cardinality)``, one row per column.
    ``approx=True`` counts distinct values with HLL sketches instead of the exact distinct shuffle."""
    s = column_stats(df)
    frac = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(F.col("n_missing") / F.col("n_rows"))
    left = s.select("column_name", "dtype", frac.alias("missing_fraction"))
    return left.join(cardinality(df, approx=approx), "column_name", "left").select(
        "column_name", "dtype", "missing_fraction", F.coalesce("cardinality", F.lit(0)).alias("cardinality"))


def problem_type_frame(df: DataFrame, target: str, *, max_unique: int = CLASSIFICATION_MAX_UNIQUE,
                       max_unique_fraction: float = CLASSIFICATION_MAX_UNIQUE_FRACTION) -> DataFrame:
    """A5 as a one-row DataFrame ``(target, problem_type, n_non_null, n_unique)``; raises at run time when the
    target is entirely missing."""
    if target not in df.columns:
        raise KeyError(f"no column named '{target}' to use as the target")
    dt = dtype_of(df, target)
    t = qcol(target)
    numeric = is_numeric(dt) or isinstance(dt, T.BooleanType)
    agg = df.agg(F.count(t).alias("n_non_null"), F.count_distinct(t).alias("n_unique"))
    n, u = F.col("n_non_null"), F.col("n_unique")
    rule = (F.when(n == 0, F.raise_error(F.lit(f"Target column '{target}' is entirely missing.")).cast("string"))
            .when(F.lit(not numeric), F.lit("classification"))
            .when((u <= max_unique) | (u / n <= max_unique_fraction), F.lit("classification"))
            .otherwise(F.lit("regression")))
    return agg.select(F.lit(target).alias("target"), rule.alias("problem_type"), n, u)


def detect_problem_type(df: DataFrame, target: str, **kw) -> str:
    """A5: 'classification' or 'regression' (one small aggregate job)."""
    return problem_type_frame(df, target, **kw).collect()[0]["problem_type"]


def target_balance(df: DataFrame, target: str, problem_type: str | None = None) -> DataFrame | None:
    """``(label STRING, n LONG, proportion DOUBLE)`` over non-null target values, largest share first (ties by
    label); None for regression.

    The total is a scalar subquery, so no single-partition window is needed over the class counts.
    """
    if problem_type is None:
        problem_type = detect_problem_type(df, target)
    if problem_type == "regression":
        return None
    t = qcol(target)
    counts = df.where(t.isNotNull()).groupBy(t.alias("_label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    return counts.select(F.col("_label").cast("string").alias("label"), "n",
                         (F.col("n") / total).alias("proportion")).orderBy(F.desc("n"), "label")


def numeric_view(df: DataFrame) -> dict[str, Column]:
    """Every column coerced to a number (numbers as is, text through ``to_num``, others null)."""
    return {f.name: to_num(qcol(f.name), f.dataType) for f in df.schema.fields}


def correlation_matrix(df: DataFrame, columns: list[str], exprs: dict[str, Column] | None = None,
                       pairs: list[tuple[str, str]] | None = None, method: str = "gram",
                       means: dict[str, float] | None = None) -> DataFrame:
    """Guarded pairwise-complete Pearson r ``(col_a, col_b, corr)`` for a < b; null when a side is constant.

    ``method="gram"``: every partition computes, with numpy, masked partial sums of all pairs at once (n, sums,
    sums of squares and cross products over rows where both values are present, columns centred on their means
    for numerical stability); Spark adds the per-pair partials with ``groupBy(i, j).sum`` — k*(k-1)/2 rows per
    task, whatever the row count, and no wide generated code.  ``method="expr"`` writes one covariance/stddev
    aggregate per pair (fine for a handful of columns)."""
    exprs = exprs or {c: to_num(qcol(c), dtype_of(df, c)) for c in columns}
    if pairs is None:
        pairs = [(a, b) for a in columns for b in columns if a < b]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    # a NaN or an infinity is a missing value: it must not hide the correlation of the other rows
    proj = df.select(*[finite(exprs[c].cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    idx = {c: i for i, c in enumerate(columns)}
    if method == "gram":
        return _gram_corr(proj, columns, pairs, idx, means)
    parts = []
    for start in range(0, len(pairs), CORR_CHUNK):
        chunk = pairs[start:start + CORR_CHUNK]
        aggs = [guarded_corr(F.col(f"c{idx[a]}"), F.col(f"c{idx[b]}")).alias(f"r{k}") for k, (a, b) in
                enumerate(chunk)]
        row = proj.agg(*aggs)
        parts.append(_long(row, [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                          F.col(f"r{k}").alias("corr")) for k, (a, b) in enumerate(chunk)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _gram_corr(proj: DataFrame, columns: list[str], pairs: list[tuple[str, str]], idx: dict[str, int],
               means: dict[str, float] | None = None) -> DataFrame:
    import numpy as np
    import pandas as pd

    k = len(columns)
    if means is None:
        means_row = collect_agg(proj, [F.avg(f"c{i}").alias(f"m{i}") for i in range(k)])
        means = {c: means_row[f"m{i}"] for i, c in enumerate(columns)}
    shift = np.array([means.get(c) or 0.0 for c in columns], dtype=np.float64)
    ii = np.array([idx[a] for a, _ in pairs])
    jj = np.array([idx[b] for _, b in pairs])

    def partial(it):
        acc = None
        for pdf in it:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            m = ~np.isnan(x)
            x0 = np.where(m, x - shift, 0.0)
            mf = m.astype(np.float64)
            n = mf.T @ mf                    # [a, b]: rows with both present
            sa = x0.T @ mf                   # [a, b]: sum of a over rows where b is present
            saa = (x0 * x0).T @ mf
            sab = x0.T @ x0
            cur = (n, sa, saa, sab)
            acc = cur if acc is None else tuple(p + q for p, q in zip(acc, cur))
        if acc is None:
            return
        n, sa, saa, sab = acc
        yield pd.DataFrame({"i": ii, "j": jj, "n": n[ii, jj], "sa": sa[ii, jj], "sb": sa[jj, ii],
                            "saa": saa[ii, jj], "sbb": saa[jj, ii], "sab": sab[ii, jj]})

    parts = proj.mapInPandas(partial, "i long, j long, n double, sa double, sb double, saa double, sbb double, "
                                      "sab double")
    tot = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    n = F.col("n")
    cov = (F.col("sab") - F.col("sa") * F.col("sb") / n) / (n - 1)
    va = (F.col("saa") - F.col("sa") * F.col("sa") / n) / (n - 1)
    vb = (F.col("sbb") - F.col("sb") * F.col("sb") / n) / (n - 1)
    den = F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0)))
    r = F.when((n >= 2) & (den > 0), cov / den)
    names = F.array(*[F.lit(c) for c in columns])
    return tot.select(F.element_at(names, (F.col("i") + 1).cast("int")).alias("col_a"),
                      F.element_at(names, (F.col("j") + 1).cast("int")).alias("col_b"),
                      # clamp rounding overshoot only; greatest/least would turn an undefined r into a bound
                      F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))).alias("corr"))


def correlation_flags(df: DataFrame, target: str, *, threshold: float = CORRELATION_THRESHOLD,
                      target_only: bool = False) -> DataFrame:
    """Pairs with |r| >= threshold over all columns coerced to numbers, strongest first (ties by name);
    ``target_only`` takes the pairs with the target alone. Non-finite values count as missing.

    A column takes part when it has at least two numeric values; nothing is returned when the target does not.
    Output ``(col_a, col_b, corr)``, names ordered a < b, r rounded to 6 digits.
    """
    if target not in df.columns:
        raise KeyError(f"no column named '{target}' to use as the target")
    exprs = {c: finite(e.cast("double")) for c, e in numeric_view(df).items()}
    counts = collect_agg(df, [x for i, e in enumerate(exprs.values())
                              for x in (F.count(e).alias(f"n{i}"), F.avg(e).alias(f"m{i}"))])
    cols = [c for i, c in enumerate(exprs) if counts[f"n{i}"] >= 2]
    empty = df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    if target not in cols:
        return empty
    means = {c: counts[f"m{i}"] for i, c in enumerate(exprs)}
    pairs = [(min(c, target), max(c, target)) for c in cols if c != target] if target_only else None
    m = correlation_matrix(df, cols, exprs, pairs=pairs, means=means)
    r = rnd(F.col("corr"), ROUND_DIGITS)
    return m.where(F.col("corr").isNotNull() & (F.abs(F.col("corr")) >= threshold)).select(
        "col_a", "col_b", r.alias("corr")).orderBy(F.abs("corr").desc(), "col_a", "col_b")


def outliers_iqr(df: DataFrame, column: str, *, k: float = 1.5, method: str = "exact") -> DataFrame:
    """One row ``(column_name, lower_bound, upper_bound, n_outliers, outlier_fraction)``.

    Quartiles come from one aggregate; the count is a second, lazy aggregate with the bounds as literals.  The
    fraction is over all rows, nulls included; NaN bounds and zeros when the column has no number.
    """
    if column not in df.columns:
        raise KeyError(f"there is no column '{column}'")
    x = to_num(qcol(column), dtype_of(df, column))
    q1, q3 = quantiles(df, {column: x}, [0.25, 0.75], method)[column]
    if q1 is None:
        lo = hi = float("nan")
        flag = F.lit(False)
    else:
        iqr = q3 - q1
        lo, hi = q1 - k * iqr, q3 + k * iqr
        flag = (x < F.lit(lo)) | (x > F.lit(hi))
    n = F.count(F.lit(1))
    nout = F.count_if(flag)
    return df.agg(F.lit(column).alias("column_name"), F.lit(lo).alias("lower_bound"), F.lit(hi).alias("upper_bound"),
                  nout.alias("n_outliers"),
                  F.when(n == 0, F.lit(0.0)).otherwise(nout / n).alias("outlier_fraction"))


def concerns(df: DataFrame, target: str, *, corr_threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Data concerns as rows ``(column_name, rule, value DOUBLE)``:
    all_null (missing fraction 1), constant (<= 1 distinct value), identifier (text column with one distinct value
    per row), target_correlation (|r| with the target >= threshold)."""
    prof = column_profile(df)
    n_rows = df.count()
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    text_cols = [c for c, d in dtypes.items() if is_string(d)]
    missing, values = F.col("missing_fraction"), F.col("cardinality")
    rules = {
        "all_null": (missing == 1.0, missing),
        "constant": ((values <= 1) & (missing < 1.0), values.cast("double")),
        "identifier": (F.col("column_name").isin(text_cols) & (values == F.lit(n_rows)) & (F.lit(n_rows) > 1), values.cast("double")),
    }
    hits = F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), value.alias("value"))) for rule, (cond, value) in rules.items()])
    found = prof.where(F.col("column_name") != F.lit(target)).select(
        "column_name", F.inline(F.filter(hits, lambda h: h.isNotNull())))
    tc = correlation_flags(df, target, threshold=corr_threshold, target_only=True).select(
        F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a")).alias("column_name"),
        F.lit("target_correlation").alias("rule"), F.col("corr").alias("value"))
    return found.unionByName(tc)
