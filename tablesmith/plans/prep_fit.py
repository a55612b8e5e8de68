"""PIPE-0..3: infer a preparation plan, fit it in a fixed number of aggregate jobs, apply it as one projection.

Fit order (each step sees the previous step's expressions, nothing is materialised in between):
null-target rows -> plan -> structural drops -> de-duplication -> datetime parts -> numeric coercion -> fills ->
encoders -> IQR clipping -> scaling.

Actions of a fit with an inferred plan: structure stats (1, whole-stage codegen), HLL cardinality of the text candidates (1), an
exact text count only for columns near the one-hot threshold, modes + categories histogram (1, also materialises the
de-duplicated base), one rank sketch of all numbers (1: fills by mean, two-value test, brackets), one read-off of all
medians and quartiles (1), target means (only with target encoding), scaler moments (1). With adaptive execution each
exchange of an action is a Spark job of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.exprs import (
    NESTED_TYPES, clip as clip_expr, datetime_parts, is_datetime, is_numeric, is_string, nan_to_null, qcol,
    scale as scale_expr, to_num, to_ts,
)
from tablesmith.operators import prep as ops
from tablesmith.operators.aggs import collect_agg
from tablesmith.operators.codes import join_codes
from tablesmith.operators.quantiles import RankSketch, between, check_method, order_statistics, sketch_ranks
from tablesmith.plans.spec import MAX_ONEHOT_CARDINALITY, PrepPlan, PrepSpec
from tablesmith.session import cut_lineage, persist

DATETIME_SHARE = 0.9
BROADCAST_MAX_ROWS = 100_000   # lookup tables up to this size (checked at fit time) are broadcast
STAGES = ("coerce", "fill", "encode", "clip", "scale")


# ---------------------------------------------------------------------------------------------------------------
# Structure statistics and plan inference (PIPE-0)
# ---------------------------------------------------------------------------------------------------------------


def structure_stats(df: DataFrame) -> dict[str, dict]:
    """One aggregate job: per column non-null count, single-value flag (``min <=> max``) and, for text columns,
    how many non-null values parse as numbers / datetimes."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    fields = df.schema.fields
    for i, f in enumerate(fields):
        c = qcol(f.name)
        aggs.append(F.count(c).alias(f"nn{i}"))
        if not isinstance(f.dataType, NESTED_TYPES):
            aggs.append(F.min(c).eqNullSafe(F.max(c)).alias(f"one{i}"))
        if is_string(f.dataType):
            aggs.append(F.count(to_num(c, f.dataType)).alias(f"num{i}"))
            aggs.append(F.count(to_ts(c, f.dataType)).alias(f"dt{i}"))
    row = collect_agg(df, aggs)
    out = {}
    for i, f in enumerate(fields):
        out[f.name] = {
            "n_rows": row["_n"], "n_non_null": row[f"nn{i}"],
            "single": bool(row[f"one{i}"]) if f"one{i}" in row else False,
            "n_number": row[f"num{i}"] if f"num{i}" in row else None,
            "n_datetime": row[f"dt{i}"] if f"dt{i}" in row else None,
            "type": f.dataType,
        }
    return out


def text_cardinality(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Distinct non-null count of text columns, as far as the plan rule (> 50 values: drop) needs it.

    An HLL pass over the candidate columns only (its own job: HLL is an imperative aggregate and would pull the
    codegen'd structure pass out of whole-stage code generation); columns whose estimate lies in the uncertain band
    around the threshold then get an exact ``(column, value)`` count.  ID-like columns never pay a distinct
    shuffle."""
    if not cols:
        return {}
    row = collect_agg(df, [F.approx_count_distinct(qcol(c), 0.02).alias(f"a{i}") for i, c in enumerate(cols)])
    out = {c: int(row[f"a{i}"]) for i, c in enumerate(cols)}
    lo, hi = MAX_ONEHOT_CARDINALITY // 2, 2 * MAX_ONEHOT_CARDINALITY
    unsure = [c for c in cols if lo <= out[c] <= hi]
    if unsure:
        structs = [F.struct(F.lit(c).alias("k"), qcol(c).alias("v")) for c in unsure]
        long = df.select(F.inline(F.array(*structs)))
        exact = {r["k"]: r["n"] for r in long.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
        for c in unsure:
            out[c] = exact.get(c, 0)
    return out


#: What an inferred plan does with a column of each role: the list it joins, its encoder, its fill (where values miss).
ROLE_ACTIONS = {
    "datetime": ("datetime_cols", None, None),
    "number": (None, None, "median"),
    "number_text": ("mixed_numeric_cols", None, "median"),
    "category": (None, "onehot", "mode"),
    "unusable": ("drop_cols", None, None),
}


def column_role(stats: dict, distinct: int | None = None) -> str | None:
    """Role of a column from its statistics; None for text whose number of ``distinct`` values is still needed."""
    kind, present = stats["type"], stats["n_non_null"]
    if is_datetime(kind):
        return "datetime"
    if is_numeric(kind) or isinstance(kind, T.BooleanType):
        return "number"
    if not is_string(kind) or not present:
        return "unusable"  # nested values cannot be features, an empty text column says nothing
    if stats["n_number"]:
        return "number_text"
    if stats["n_datetime"] >= DATETIME_SHARE * present:
        return "datetime"
    if distinct is None:
        return None
    return "category" if 1 < distinct <= MAX_ONEHOT_CARDINALITY else "unusable"


def infer_plan_from_stats(stats: dict[str, dict], ndv: dict[str, int], target: str) -> PrepPlan:
    """PIPE-0: each column's role, looked up in ``ROLE_ACTIONS``."""
    plan = PrepPlan()
    for name, s in stats.items():
        if name == target:
            continue
        group, encoder, fill = ROLE_ACTIONS[column_role(s, ndv.get(name, 0))]
        if group:
            getattr(plan, group).append(name)
        if encoder:
            plan.encode[name] = encoder
        # text that is not all numbers loses values when it is coerced
        gaps = s["n_non_null"] < s["n_rows"] or (group == "mixed_numeric_cols" and s["n_number"] < s["n_non_null"])
        if fill and gaps:
            plan.impute[name] = fill
    return plan


def _categorical_candidates(stats: dict[str, dict], target: str) -> list[str]:
    return [c for c, s in stats.items() if c != target and column_role(s) is None]


def override_plan(inferred: PrepPlan, given: PrepPlan) -> PrepPlan:
    """R2: the inferred plan with ``given`` in place of it for every column that ``given`` names; its other settings hold."""
    plan = given.copy()
    named = {*given.drop_cols, *given.datetime_cols, *given.mixed_numeric_cols, *given.impute, *given.encode}
    for group in ("drop_cols", "datetime_cols", "mixed_numeric_cols"):
        getattr(plan, group).extend(c for c in getattr(inferred, group) if c not in named)
    plan.impute.update({c: s for c, s in inferred.impute.items() if c not in named})
    plan.encode.update({c: s for c, s in inferred.encode.items() if c not in named})
    return plan


def infer_plan(df: DataFrame, target: str) -> PrepPlan:
    """PIPE-0: datetime / numeric / text branches; drop all-null, <= 1-value and > 50-value text columns; median
    for numbers and coerced text, mode + one-hot for categories.  Two jobs."""
    if target not in df.columns:
        raise KeyError(f"no column named '{target}' to use as the target")
    df = ops.drop_null_target(nan_to_null(df), target)
    stats = structure_stats(df)
    ndv = text_cardinality(df, _categorical_candidates(stats, target))
    return infer_plan_from_stats(stats, ndv, target)


def plan_table(plan: PrepPlan, columns: list[str], target: str, spark) -> DataFrame:
    """The plan as rows ``(column_name, action, detail)`` (for reports and checks)."""
    rows = []
    for c in columns:
        if c == target:
            rows.append((c, "target", None))
        elif c in plan.drop_cols:
            rows.append((c, "drop", None))
        elif c in plan.datetime_cols:
            rows.append((c, "datetime", plan.impute.get(c)))
        elif c in plan.mixed_numeric_cols:
            rows.append((c, "coerce", plan.impute.get(c)))
        elif c in plan.encode:
            rows.append((c, plan.encode[c], plan.impute.get(c)))
        else:
            rows.append((c, "keep", plan.impute.get(c)))
    return spark.createDataFrame(rows, "column_name string, action string, detail string")


# ---------------------------------------------------------------------------------------------------------------
# Shared expression builder (fit and apply use the same code)
# ---------------------------------------------------------------------------------------------------------------


def _lit_fill(value, kind: str) -> Column:
    if kind == "num":
        return F.lit(float(value)).cast("double")
    return F.lit(value)


def _coerce_stage(types: dict[str, T.DataType], spec: PrepSpec) -> tuple[dict[str, Column], dict[str, str]]:
    """Stage 0 expressions over the input columns (datetime text already parsed into ``__ts_<col>``)."""
    cur: dict[str, Column] = {}
    kind: dict[str, str] = {}
    for c in spec.input_columns:
        if c in spec.dropped_columns or c not in types or c in spec.datetime_columns:
            continue
        dt = types[c]
        if c == spec.target:
            cur[c], kind[c] = qcol(c), "target"
        elif c in spec.coerced_columns or is_numeric(dt) or isinstance(dt, T.BooleanType):
            cur[c], kind[c] = to_num(qcol(c), dt), "num"
        elif is_string(dt):
            cur[c], kind[c] = qcol(c), "str"
        else:
            cur[c], kind[c] = qcol(c), "other"
    for c in spec.datetime_columns:
        if c in types:
            for part, e in datetime_parts(qcol(f"__ts_{c}"), T.TimestampNTZType()).items():
                cur[f"{c}_{part}"], kind[f"{c}_{part}"] = e, "num"
    return cur, kind


def staged(df: DataFrame, spec: PrepSpec, upto: str = "scale", keep: list[str] | tuple = (),
           coerced: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The prepared columns after stage ``upto`` (coerce, fill, encode, clip, scale) as a DataFrame, plus
    ``{name: kind}`` (num / str / other / target).  Fit and apply both use this one builder.

    Every stage is its own projection over the previous stage's columns *by name*, so an expression is never
    re-nested into the next one (a clip reads its input three times; nesting parse -> fill -> clip -> scale would
    grow the generated code multiplicatively).  ``keep`` columns pass through every stage unchanged.  ``coerced`` tells that ``df`` is what stage ``coerce`` made,
    with these kinds: the fit parses its text columns once."""
    stop = STAGES.index(upto)
    types = {f.name: f.dataType for f in df.schema.fields}
    keep = [k for k in keep if k in df.columns]
    kept = [qcol(k) for k in keep]
    if coerced is None:
        parsed = [to_ts(qcol(c), types[c]).alias(f"__ts_{c}") for c in spec.datetime_columns if c in types]
        src = df.select("*", *parsed) if parsed else df
        cur, kind = _coerce_stage(types, spec)
        out = src.select(*kept, *[e.alias(n) for n, e in cur.items()])
    else:
        out, kind = df, dict(coerced)
    names = list(kind)
    if stop < 1:
        return out, kind
    fills = {n: v for n, v in spec.fills.items() if n in kind and v is not None and kind[n] != "target"}
    out = out.select(*kept, *[(F.coalesce(qcol(n), _lit_fill(fills[n], kind[n])) if n in fills else qcol(n)).alias(n)
                              for n in names])
    if stop < 2:
        return out, kind
    out = _with_lookups(out, spec)
    new: dict[str, Column] = {}
    tail: dict[str, Column] = {}
    for n in names:
        if n in spec.onehot:
            kind.pop(n)
            for name, x in ops.onehot_exprs(qcol(n), n, spec.onehot[n]).items():
                tail[name] = x.cast("double")
                kind[name] = "num"
        elif n in spec.ordinal:
            stored = isinstance(spec.ordinal[n], dict)
            new[n] = ops.ordinal_code(F.col(f"__oc_{n}")) if stored else ops.ordinal_expr(qcol(n), spec.ordinal[n])
            kind[n] = "num"
        elif n in spec.target_maps:
            entry = spec.target_maps[n]
            if "path" in entry:
                new[n] = F.coalesce(F.col(f"__te_{n}"), F.lit(entry["global_mean"]).cast("double"))
            else:
                new[n] = ops.target_expr(qcol(n), entry)
            kind[n] = "num"
        else:
            new[n] = qcol(n)
    new.update(tail)
    out = out.select(*kept, *[e.alias(n) for n, e in new.items()])
    names = list(new)
    if stop < 3:
        return out, kind
    out = out.select(*kept, *[(clip_expr(qcol(n), *spec.clip_bounds[n]) if n in spec.clip_bounds else qcol(n))
                              .alias(n) for n in names])
    if stop < 4:
        return out, kind
    out = out.select(*kept, *[(scale_expr(qcol(n), spec.scalers[n][1], spec.scalers[n][2]) if n in spec.scalers
                               else qcol(n)).alias(n) for n in names])
    return out, kind


def output_names(spec: PrepSpec, types: dict[str, T.DataType], upto: str = "scale") -> list[str]:
    """Output column names after a stage, without building a DataFrame."""
    cur, kind = _coerce_stage(types, spec)
    names = list(cur)
    if STAGES.index(upto) < 2:
        return names
    out, tail = [], []
    for n in names:
        if n in spec.onehot:
            tail += [ops.onehot_name(n, cat) for cat in spec.onehot[n]]
        else:
            out.append(n)
    return out + tail


def _with_lookups(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """Join stored target-encoding lookup tables (large category sets) as ``__te_<col>`` columns, keyed on the
    filled column; broadcast only when the size recorded at fit time is small."""
    spark = df.sparkSession
    for c, entry in spec.ordinal.items():
        if isinstance(entry, dict) and c in df.columns:
            df = join_codes(df, qcol(c), entry["path"], f"__oc_{c}")
    for c, entry in spec.target_maps.items():
        if "path" not in entry or c not in df.columns:
            continue
        lk = spark.read.parquet(entry["path"]).select(F.col("v").alias(f"__k_{c}"), F.col("mean").alias(f"__te_{c}"))
        if entry.get("size", 0) <= BROADCAST_MAX_ROWS:
            lk = F.broadcast(lk)
        df = df.join(lk, qcol(c).cast("string") == F.col(f"__k_{c}"), "left").drop(f"__k_{c}")
    return df


# ---------------------------------------------------------------------------------------------------------------
# Fit (PIPE-1), apply (PIPE-2), fit + apply (PIPE-3)
# ---------------------------------------------------------------------------------------------------------------


def _check_names(names: list[str]) -> None:
    """Two prepared columns of one name would silently become one."""
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"preparation makes several columns named {twice}; rename a column or encode it differently")


def fit_prep(df: DataFrame, target: str, plan: PrepPlan | None = None, *, infer_rest: bool = False) -> PrepSpec:
    """PIPE-1: learn a ``PrepSpec`` from training rows.  The caller's plan is never mutated; with ``infer_rest`` the
    columns it does not name are treated as the inferred plan would."""
    return _fit(df, target, plan, infer_rest, store=False)[0]


def _fit(df: DataFrame, target: str, plan: PrepPlan | None, infer_rest: bool, store: bool) -> tuple[PrepSpec, DataFrame, dict[str, str]]:
    """The spec, and the training rows it was learned from: de-duplicated, text parsed, with the columns' kinds. With ``store``
    these rows are in the shared checkpoint folder and can be used on; otherwise they are cached for the fit alone."""
    spec, plan, base, types, known_small = training_rows(df, target, plan, infer_rest)
    # every later pass reads the de-duplicated rows with their text already parsed
    parsed, kind = staged(base, spec, "coerce")
    parsed = cut_lineage(parsed) if store else persist(parsed)
    try:
        _fit_statistics(parsed, kind, spec, plan, types, plan.quantiles, known_small)
    finally:
        if not store:
            parsed.unpersist()
    return spec, parsed, kind


def training_rows(df: DataFrame, target: str, plan: PrepPlan | None, infer_rest: bool = False
                  ) -> tuple[PrepSpec, PrepPlan, DataFrame, dict[str, T.DataType], set[str]]:
    """What a fit decides before it learns any statistic: (spec without statistics, resolved plan, training rows after drops and
    de-duplication, their types, columns known to have few values)."""
    if target not in df.columns:
        raise KeyError(f"no column named '{target}' to use as the target")
    for f in df.schema.fields:
        if isinstance(f.dataType, NESTED_TYPES) and (plan is None or f.name not in plan.drop_cols):
            raise TypeError(f"Column '{f.name}' is nested ({f.dataType.simpleString()}); drop it before prep.")
    input_types = {f.name: f.dataType for f in df.schema.fields}
    src = ops.drop_null_target(nan_to_null(df), target)
    stats = structure_stats(src)
    inferred = plan is None
    if plan is None or infer_rest:
        ndv = text_cardinality(src, _categorical_candidates(stats, target))
        found = infer_plan_from_stats(stats, ndv, target)  # its one-hot columns have <= 50 values
        plan = found if plan is None else override_plan(found, plan)
    else:
        plan = plan.copy()
    plan.validate(target)

    reason = dict.fromkeys(plan.drop_cols, 2) | {c: int(s["n_non_null"] > 0) for c, s in stats.items() if s["single"] or not s["n_non_null"]}
    reason.pop(target, None)
    dropped = sorted(reason, key=reason.get)  # without a value, with one value, by the plan
    if plan.dedupe == "before_drop":
        base = ops.drop_columns(ops.dedupe_rows(src), dropped)
    else:
        base = ops.dedupe_rows(ops.drop_columns(src, dropped))
    types = {f.name: f.dataType for f in base.schema.fields}
    spec = PrepSpec(target=target, input_columns=list(df.columns),
                    input_types={k: v.simpleString() for k, v in input_types.items()},
                    dropped_columns=dropped, dedupe=plan.dedupe, plan=plan.to_dict())
    spec.datetime_columns = [c for c in plan.datetime_cols if c in types and c != target]
    spec.coerced_columns = [c for c in plan.mixed_numeric_cols if c in types and c != target
                            and c not in spec.datetime_columns]
    spec.bool_columns = [c for c, t in types.items() if isinstance(t, T.BooleanType) and c != target]

    return spec, plan, base, types, set(plan.encode) if inferred else set()


def _fit_statistics(parsed: DataFrame, parsed_kind: dict[str, str], spec: PrepSpec, plan: PrepPlan, types: dict, method: str,
                    known_small: set[str]) -> PrepSpec:
    """The statistics of a resolved plan over the coerced training rows."""
    target, work, kind = spec.target, parsed, dict(parsed_kind)

    def stage(upto: str) -> tuple[DataFrame, dict[str, str]]:
        return staged(parsed, spec, upto, coerced=parsed_kind)

    # fills (datetime parts get a median unless the plan says otherwise; the plan copy is what changes)
    impute = dict(plan.impute)
    cur = {n: qcol(n) for n in kind}
    dated = set(types) & set(spec.datetime_columns)
    always = [n for n in kind if kind[n] == "num" and (plan.impute_all or n not in types or n in dated)]
    impute = dict.fromkeys(always, "median") | impute
    strategies = {c: s for c, s in impute.items() if c in cur and kind[c] != "target"}
    numeric = {c: kind[c] == "num" for c in cur}
    enc = {c: s for c, s in plan.encode.items() if c in cur and kind[c] != "target"}
    cat_cols = [c for c, s in enc.items() if s == "onehot" or (s == "ordinal" and c in known_small)]
    coded = [c for c, s in enc.items() if s == "ordinal" and c not in known_small]
    mode_cols = [c for c, s in strategies.items() if s == "mode"]
    # one histogram job gives the modes and the categories (a mode fill adds no new category)
    hist_cols = list(dict.fromkeys(mode_cols + cat_cols))
    vs = ops.value_summary(work, {c: cur[c] for c in hist_cols}, numeric, categories_for=cat_cols, max_categories=None,
                           known_small=frozenset(known_small)) if hist_cols else {}
    num = [c for c in kind if kind[c] == "num"]
    sketch = sketch_ranks(work, {c: cur[c] for c in num}) if num else None
    medians = [c for c, s in strategies.items() if s == "median" and c in sketch.columns] if sketch else []
    text_medians = {c: s for c, s in strategies.items() if s in ("median", "mean") and (sketch is None or c not in sketch.columns)}
    constants = {c: s for c, s in strategies.items() if s == "constant"}
    spec.fills = ops.fit_fills(work, {c: cur[c] for c in text_medians | constants}, text_medians | constants, numeric, plan.fill_values, method)
    for c, s in strategies.items():
        if s == "mean" and c not in text_medians:
            spec.fills[c] = sketch.columns[c].total / sketch.columns[c].n if sketch.columns[c].n else None
    for c in mode_cols:
        m = vs.get(c, {}).get("mode")
        spec.fills[c] = 0.0 if m is None else (float(m) if numeric.get(c) else str(m))

    # medians and the quartiles of the filled values are read off together; what is encoded is clipped only on demand
    plain = [c for c in num if c not in enc and c not in spec.bool_columns] if plan.iqr_k is not None and not plan.clip_encoded else []
    quartiles: dict[str, list] = {}
    if sketch:
        found = _read(sketch, _wanted_ranks(sketch, medians, plain, strategies), method)
        quartiles = _medians_and_quartiles(sketch, found, medians, plain, strategies, spec.fills)

    # encoders
    for c in cat_cols:
        cats = vs[c]["categories"]
        fill = spec.fills.get(c)
        if vs[c]["has_null"] and fill is not None and fill not in cats:
            cats = sorted(cats + [float(fill) if numeric.get(c) else fill])
        (spec.onehot if enc[c] == "onehot" else spec.ordinal)[c] = cats
    te_cols = [c for c, s in enc.items() if s == "target"]
    if te_cols or coded:
        work, kind = stage("fill")
    if coded:  # categories of the filled column
        spec.ordinal.update(ops.fit_categories(work, {c: qcol(c) for c in coded}, numeric, "ordinal"))
    if te_cols:
        spec.target_maps = ops.fit_target_means(work, {c: qcol(c) for c in te_cols}, qcol(target))
    spec.encoded_columns = [c for c in spec.ordinal] + [c for c in spec.target_maps] + [
        ops.onehot_name(c, cat) for c, cats in spec.onehot.items() for cat in cats]

    _check_names(output_names(spec, types, "encode"))

    # clipping: numeric features; by default not encoded columns, original booleans or two-valued columns
    work, kind = stage("encode")
    num_cols = [c for c in work.columns if kind.get(c) == "num"]
    if plan.iqr_k is not None and plan.clip_encoded and num_cols:
        spec.clip_bounds = ops.fit_clip_iqr(work, {c: qcol(c) for c in num_cols}, plan.iqr_k, method)
    if plain:
        spec.clip_bounds.update(_clip_bounds(sketch, quartiles, spec.fills, plan.iqr_k))

    # scaling over clipped values
    work, kind = stage("clip")
    spec.scalers = ops.fit_scalers(work, {c: qcol(c) for c in num_cols}, plan.scale_strategy, method)
    spec.output_columns = output_names(spec, types)
    spec.sources = {ops.onehot_name(c, cat): c for c, cats in spec.onehot.items() for cat in cats} | {
        f"{c}_{part}": c for c in spec.datetime_columns for part in ("year", "month", "day", "dayofweek")}
    return spec


def _filled_ranks(sketch: RankSketch, col: str, filled: bool) -> tuple[list[float], int]:
    """Fractional ranks of the quartiles among the values with their fills, and how many fills there are."""
    column = sketch.columns[col]
    fills = sketch.rows - column.n if filled and column.n else 0
    return [p * (column.n + fills - 1) for p in (0.25, 0.75)] if column.n else [], fills


def _wanted_ranks(sketch: RankSketch, medians: list[str], clipped: list[str], strategies: dict[str, str]) -> dict[str, list[int]]:
    """Ranks from which the medians, and the quartiles of the filled columns that are clipped, can be told.

    The r-th smallest of n values and c copies of a fill f is the r-th value where that is at most f, the (r - c)-th one where
    that is at least f, and f otherwise; so both are read off before f is known.
    """
    wanted: dict[str, set[int]] = {c: set() for c in dict.fromkeys((*medians, *clipped)) if sketch.columns[c].n}
    for c in medians:
        if c in wanted:
            r = 0.5 * (sketch.columns[c].n - 1)
            wanted[c] |= {math.floor(r), math.ceil(r)}
    for c in clipped:
        ranks, extra = _filled_ranks(sketch, c, c in strategies)
        for r in ranks:
            for k in (math.floor(r), math.ceil(r)):
                wanted[c] |= {x for x in (k, k - extra) if 0 <= x < sketch.columns[c].n}
    return {c: sorted(rs) for c, rs in wanted.items() if rs}


def _medians_and_quartiles(sketch: RankSketch, found: dict[str, dict[int, float]], medians: list[str], clipped: list[str],
                           strategies: dict[str, str], fills: dict[str, object]) -> dict[str, list]:
    """Put the medians into ``fills`` and return the quartiles of the filled columns, from the values found at the wanted ranks."""
    for c in medians:
        r = 0.5 * (sketch.columns[c].n - 1)
        fills[c] = between(found[c][math.floor(r)], found[c][math.ceil(r)], r) if c in found else None

    def at(c: str, k: int, extra: int) -> float:
        values, n = found[c], sketch.columns[c].n
        if not extra:
            return values[k]
        fill = float(fills[c])
        if k < n and values[k] <= fill:
            return values[k]
        return values[k - extra] if k >= extra and values[k - extra] >= fill else fill

    out = {}
    for c in clipped:
        ranks, extra = _filled_ranks(sketch, c, c in strategies and fills.get(c) is not None)
        out[c] = [between(at(c, math.floor(r), extra), at(c, math.ceil(r), extra), r) for r in ranks] or [None, None]
    return out


def _read(sketch: RankSketch, wanted: dict[str, list[int]], method: str) -> dict[str, dict[int, float]]:
    check_method(method)
    if method == "approx":
        return {c: {r: sketch.columns[c].near(r) for r in rs} for c, rs in wanted.items()}
    return order_statistics(sketch, wanted)


def _clip_bounds(sketch: RankSketch, quartiles: dict[str, list], fills: dict[str, object], k: float) -> dict[str, list]:
    """IQR bounds of the columns whose filled values take more than two numbers."""
    out = {}
    for c, (q1, q3) in quartiles.items():
        if not _is_two_valued(*_filled_moments(sketch, c, fills.get(c))):
            out[c] = [float("nan")] * 2 if q1 is None else [q1 - k * (q3 - q1), q3 + k * (q3 - q1)]
    return out


def _filled_moments(sketch: RankSketch, col: str, fill) -> tuple:
    """Count, extremes, sum and sum of squares of a column with its fills."""
    c = sketch.columns[col]
    extra = sketch.rows - c.n if fill is not None else 0
    if not c.n and not extra:
        return 0, None, None, None, None
    f = float(fill) if extra else 0.0
    low, high = (min(x for x in (v, f if extra else None) if x is not None) if s < 0 else max(x for x in (v, f if extra else None) if x is not None)
                 for s, v in ((-1, c.low), (1, c.high)))
    return c.n + extra, low, high, (c.total or 0.0) + extra * f, (c.squares or 0.0) + extra * f * f


def _is_two_valued(n, m, M, s, q) -> bool:
    if not n:
        return False
    if M == m:
        return True
    gap = (m + M) * s - n * m * M - q
    tol = 1e-9 * max(1.0, abs(q), abs((m + M) * s), abs(n * m * M))
    return abs(gap) <= tol


def apply_prep(df: DataFrame, spec: PrepSpec, mode: str = "train", keep: list[str] | tuple = ()) -> DataFrame:
    """PIPE-2: apply a fitted spec as one projection, never refitting.

    ``mode="train"`` repeats the fit-time row steps (null-target filter, de-duplication); ``mode="score"`` keeps every
    input row so predictions stay aligned with their keys: columns unknown at fit time and the ``keep`` columns
    (e.g. an id dropped by the plan) pass through untouched.  Input columns are cast to their fit-time types first.
    """
    missing = [c for c in spec.input_columns if c not in df.columns and c != spec.target
               and c not in spec.dropped_columns]
    if missing:
        raise KeyError(f"Columns seen at fit time are missing: {missing}")
    casts = []
    for f in df.schema.fields:
        want = spec.input_types.get(f.name)
        if want and f.dataType.simpleString() != want:
            casts.append(qcol(f.name).cast(want).alias(f.name))
        else:
            casts.append(qcol(f.name))
    df = nan_to_null(df.select(*casts))
    outputs = set(output_names(spec, {f.name: f.dataType for f in df.schema.fields}, "coerce")) | set(
        spec.output_columns)
    passthrough = [c for c in df.columns if (c not in spec.input_columns or c in keep) and c not in outputs]
    if mode == "train":
        # training rows are exactly the fit-time columns: de-duplication must not see columns the spec never saw
        df = df.select(*[qcol(c) for c in spec.input_columns if c in df.columns])
        if spec.target in df.columns:
            df = df.where(qcol(spec.target).isNotNull())
    if mode == "train" and spec.dedupe == "before_drop":
        df = ops.dedupe_rows(df)
    df = ops.drop_columns(df, [c for c in spec.dropped_columns if not (mode == "score" and c in passthrough)])
    if mode == "train" and spec.dedupe != "before_drop":
        df = ops.dedupe_rows(df)
    out, _ = staged(df, spec, "scale", keep=passthrough if mode == "score" else ())
    return out


def prep_dataframe(df: DataFrame, target: str, plan: PrepPlan | None = None, *, infer_rest: bool = False) -> tuple[DataFrame, PrepSpec]:
    """PIPE-3: fit on ``df`` and apply to it. The de-duplicated, parsed rows are written to the shared checkpoint folder once; the fit
    reads its statistics from them and the result is a projection of them, so full rows are shuffled once."""
    spec, parsed, kind = _fit(df, target, plan, infer_rest, store=True)
    return staged(parsed, spec, "scale", coerced=kind)[0], spec


def spec_table(spec: PrepSpec, spark) -> DataFrame:
    """Learned statistics as rows ``(column_name, stat, value DOUBLE)``: fills (numbers), clip bounds, scaler
    centre and scale, and the number of categories of each encoder."""
    rows = []
    for c, v in spec.fills.items():
        if isinstance(v, (int, float)):
            rows.append((c, "fill", float(v)))
    for c, (lo, hi) in spec.clip_bounds.items():
        rows += [(c, "clip_lower", float(lo)), (c, "clip_upper", float(hi))]
    for c, (_s, center, sc) in spec.scalers.items():
        rows += [(c, "center", float(center)), (c, "scale", float(sc))]
    for c, cats in {**spec.onehot, **spec.ordinal}.items():
        rows.append((c, "n_categories", float(cats["size"] if isinstance(cats, dict) else len(cats))))
    return spark.createDataFrame(rows, "column_name string, stat string, value double")
