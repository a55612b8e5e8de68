"""Column expressions shared by every operator.

All helpers return built-in Spark ``Column`` expressions (JVM side, inside whole-stage codegen); none is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------------------------
# Fixed values (must stay exactly as written for parity with the behaviour being reproduced)
# ---------------------------------------------------------------------------------------------------------------

# Text tokens a CSV reader treats as missing (the default NA token list of the pandas CSV reader).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# A plain decimal number with optional sign and exponent, surrounding blanks allowed.  Spark's cast alone also
# accepts "1d" / "1f" and DuckDB's accepts "1_000"; the pattern rejects both so every engine agrees.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INF_PATTERN = r"^\s*[+-]?(?i)(inf|infinity)\s*$"

# Datetime text formats tried in order (month-first before day-first).  Clock-dependent words are not accepted.
DATETIME_FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyyMMdd",
    "yyyy",
]

# For each format, the shape of the texts it can parse (years of four digits; months and days of two, or of any up to four
# where the pattern has one letter). A format is only tried on text of its shape: a failed attempt is an exception, which costs
# some 40 times a parse, and without the shapes every row of a column of short numbers would raise several.
DATETIME_SHAPES = {
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$",
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "M/d/yyyy": r"^\d{1,4}/\d{1,4}/\d{4}$",
    "d/M/yyyy": r"^\d{1,4}/\d{1,4}/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
    "yyyy": r"^\d{4}$",
}

# Rounding applied to every floating statistic that leaves the engine in a report or check table.
ROUND_DIGITS = 6

# ---------------------------------------------------------------------------------------------------------------

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def qcol(name: str) -> Column:
    """Column by exact name (names from data may hold dots, spaces or dashes)."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_missing(c: Column, dt: T.DataType) -> Column:
    """pandas-style missing test: null, and NaN for floating columns."""
    if isinstance(dt, FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def no_nan(c: Column) -> Column:
    """A floating-point expression with NaN as null."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """A floating-point expression with NaN and infinities as null (NaN is greater than infinity in Spark)."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every float/double column, once at the source (Spark keeps NaN != null)."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, FLOAT_TYPES):
            exprs.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            exprs.append(c)
    return df.select(*exprs) if changed else df


def to_num(c: Column, dt: T.DataType | None = None) -> Column:
    """Coerce to double; text that is not a plain number becomes null (see NUMBER_PATTERN)."""
    if dt is not None and (is_numeric(dt) or isinstance(dt, T.BooleanType)):
        return c.cast("double")
    if dt is not None and not is_string(dt):
        return F.lit(None).cast("double")
    s = c.cast("string")
    return (F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))
            .when(s.rlike(INF_PATTERN), F.trim(s).try_cast("double")))


def to_ts(c: Column, dt: T.DataType | None = None) -> Column:
    """Parse a datetime from text with the fixed ordered format list; bad text becomes null."""
    if dt is not None and is_datetime(dt):
        return c.cast("timestamp_ntz")
    if dt is not None and not is_string(dt):
        return F.lit(None).cast("timestamp_ntz")
    s = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.when(s.rlike(DATETIME_SHAPES[f]), F.try_to_timestamp(s, F.lit(f)))
                          for f in DATETIME_FORMATS]).cast("timestamp_ntz")
    return F.when(s.rlike(r"^\d"), parsed)  # every shape starts with a digit: one cheap test for other text


def datetime_parts(c: Column, dt: T.DataType | None = None) -> dict[str, Column]:
    """Year, month, day, day-of-week (Monday = 0) as doubles."""
    ts = to_ts(c, dt)
    return {
        "year": F.year(ts).cast("double"),
        "month": F.month(ts).cast("double"),
        "day": F.dayofmonth(ts).cast("double"),
        "dayofweek": F.weekday(ts).cast("double"),
    }


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson r over pairwise-complete rows; null (not an error) when either side is constant.

    ``corr`` raises DIVIDE_BY_ZERO under ANSI mode for a constant column, so the ratio is written out with nullif.
    """
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    return F.covar_samp(a2, b2) / F.nullif(F.stddev_samp(a2) * F.stddev_samp(b2), F.lit(0.0))


def clip(c: Column, lower: float, upper: float) -> Column:
    """Clip to [lower, upper]; null stays null (greatest/least would turn null into a bound)."""
    return F.when(c < F.lit(lower), F.lit(lower)).when(c > F.lit(upper), F.lit(upper)).otherwise(c)


def scale(c: Column, center: float, scale_: float) -> Column:
    return (c.cast("double") - F.lit(center)) / F.lit(scale_)


def rnd(c: Column, digits: int = ROUND_DIGITS) -> Column:
    return F.round(c.cast("double"), digits)


def hash_fraction_key(c: Column) -> Column:
    """First 32 bits of md5 of the text form as a non-negative BIGINT (same value in DuckDB)."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def unpivot_as_text(df: DataFrame, columns: list[str], name_col: str = "column_name",
                    value_col: str = "value") -> DataFrame:
    """Long form ``(column_name, value STRING)`` of the given columns; nested values as JSON text."""
    structs = []
    for c in columns:
        dt = dtype_of(df, c)
        v = F.to_json(qcol(c)) if isinstance(dt, NESTED_TYPES) else qcol(c).cast("string")
        structs.append(F.struct(F.lit(c).alias(name_col), v.alias(value_col)))
    return df.select(F.inline(F.array(*structs)))
