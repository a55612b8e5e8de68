"""A datetime format is tried only on text it can parse: short numbers raise no exceptions, and every text parses as without the shapes."""

import itertools
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.exprs import DATETIME_FORMATS, DATETIME_SHAPES, to_ts


def test_short_numbers_are_tried_with_no_format():
    for text in ("3", "74", "742", "0742x", "12345", "1234567", "123450101", "1-2-3", "24/3/9"):
        assert [f for f in DATETIME_FORMATS if re.match(DATETIME_SHAPES[f], text)] == []


def test_shapes_change_no_result(spark):
    parts = ["1", "01", "13", "31", "742", "2024", "20240"]
    texts = ["".join(x) for x in itertools.product(parts, "-/", parts, "-/", parts)] + [str(i) for i in range(0, 12000, 97)]
    texts += ["20240229", "20230229", "123450101", "1234567", "0000", " 2024 ", "2024\n", "2024-03-09 01:02", "2024-03-09 1:02", "2024-03-09T01:02:03", "2024-03-09 24:00:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    s = F.trim("t")
    plain = F.when(s.rlike(r"^\d"), F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in DATETIME_FORMATS]).cast("timestamp_ntz"))
    both = df.select(to_ts(F.col("t"), T.StringType()).alias("a"), plain.alias("b"))
    assert both.where("not (a <=> b)").isEmpty() and both.where("a is not null").count() > 50
