from tablesmith.functions.exprs import (  # noqa: F401
    DATETIME_FORMATS, NA_TOKENS, NUMBER_PATTERN, clip, datetime_parts, guarded_corr, nan_to_null, qcol, scale,
    to_num, to_ts,
)
