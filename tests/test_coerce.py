import datetime as dt
import warnings

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataward.constants import NA_TOKENS
from dataward.functions.coerce import (
    date_layouts,
    date_readings,
    infer_types,
    nan_to_null,
    null_tokens,
    parse_dates,
    safe_double,
    safe_timestamp,
    strip,
)

NUMBERS = ["1", " 5 ", "-2.5", "1e3", "5.", ".5", "inf", "-Infinity", "1d", "2f", "0x1p3",
           "0x10", "1,000", "1_000", "True", "abc", "", "+7", "--3", "1.2.3"]


def test_safe_double_agrees_with_pandas(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "v string")
    got = [r.d for r in df.select(safe_double(F.col("v"), T.StringType()).alias("d")).collect()]
    want = pd.to_numeric(pd.Series(NUMBERS), errors="coerce")
    assert got == [None if pd.isna(w) else float(w) for w in want]


def test_safe_double_drops_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "v double")
    got = [r.d for r in df.select(safe_double(F.col("v"), T.DoubleType()).alias("d")).collect()]
    assert got == [None, 2.0, None]
    assert [r.v for r in nan_to_null(df).collect()] == [None, 2.0, None]


def test_safe_timestamp(spark):
    values = ["2024-01-31", "2024-02-30", "2024-01-31 10:20:30", "2024-01-31T10:20:30",
              "31.01.2024", "2024", "not-a-date", "", "2024-13-01", "2024-01-31 trailing"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.t is not None for r in
           df.select(safe_timestamp(F.col("v"), T.StringType()).alias("t")).collect()]
    assert got == [True, False, True, True] + [False] * 6


def test_null_tokens_and_strip(spark):
    df = spark.createDataFrame([(t,) for t in [*NA_TOKENS, "none", "--", "x"]], "v string")
    assert [r.v for r in null_tokens(df).collect() if r.v is not None] == ["none", "--", "x"]
    text = spark.createDataFrame([("\t a b \n",)], "v string")
    assert text.select(strip(F.col("v")).alias("v")).first().v == "a b"


def test_infer_types(spark):
    rows = [("1", "1.5", "true", "x", "1", None), ("-20", "2", "False", "1", None, None),
            (" 3 ", None, "TRUE", "2", "y", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    typed = infer_types(df, drop_empty=True)
    assert dict(typed.dtypes) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string",
                                  "e": "string"}
    assert [r.a for r in typed.collect()] == [1, -20, 3]


def test_infer_types_looks_past_the_first_rows(spark):
    late = spark.range(5000).selectExpr(
        "CASE WHEN id = 4321 THEN 'late' ELSE cast(id AS string) END AS v")
    assert dict(infer_types(late).dtypes) == {"v": "string"}


LAYOUTS = ["%d %b %Y", "%Y%m%d", "%Y.%m.%d", "%m/%d/%Y", "%d/%m/%Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%d-%b-%Y",
           "%b %d %Y", "%d.%m.%Y", "%m-%d-%Y", "%m/%d/%y", "%d-%b-%y", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M",
           "%m/%d/%Y %I:%M %p", "%d %b %Y %H:%M:%S", "%Y%m%d %H:%M:%S", "%d%b%Y", "%d/%b/%Y", "%Y-%m-%dT%H:%M:%S"]


def test_columns_of_one_layout_are_read_as_pandas_reads_them(spark):
    # two-digit years on the side of the century where no window matters; the first value of a
    # column with the day first shows it
    days = [dt.datetime(1980 + i % 40, 1 + i % 12, 28 - (i * 7) % 28, i % 24, (i * 13) % 60, (i * 17) % 60) for i in range(60)]
    columns = {f"date{i}": [d.strftime(f) for d in days] for i, f in enumerate(LAYOUTS)}
    df = spark.createDataFrame(pd.DataFrame(columns))
    got = parse_dates(df, date_layouts(df)).toPandas()
    for name, values in columns.items():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = pd.to_datetime(pd.Series(values), errors="coerce")
        assert not want.isna().any()
        assert got[name].tolist() == want.tolist(), values[0]


@pytest.mark.parametrize("values,layout,ambiguous", [
    (["05/01/2024", "06/02/2024"], "M/d/yyyy", True), (["05/01/2024", "2024-01-05"], None, True),
    (["05/01/2024", "25/01/2024", "2024-01-05", "junk"], "d/M/yyyy", False), (["13/01/2024", "01/13/2024"], None, True),
    (["45/45/2024", "1/25/2024"], "M/d/yyyy", False), (["2024-01-05", None, ""], None, False), ([None], None, False),
    (["5 Jan 2024", "1.2.2024"], None, True), (["99/99/2024"], None, False)])
def test_readings(spark, values, layout, ambiguous):
    df = spark.createDataFrame([(v, v) for v in values], "some_date string, other string")
    rows = date_readings(df).collect()
    assert [(r.column_name, r.layout, r.ambiguous) for r in rows] == [("some_date", layout, ambiguous)]
    assert date_readings(df, ["other"]).count() == 0 and date_layouts(df, []) == {}


def test_impossible_days_are_null(spark):
    values = ["31.02.2024", "32 Jan 2024", "5 Foo 2024", "20241301", "2024.13.01", "Jan 5", "5 Jan 2024 25:00", "13:00",
              "5 May 2024 13:30 PM", "2024-01-05"]
    df = spark.createDataFrame([(v,) for v in values], "a_date string")
    got = [r.a_date for r in parse_dates(df, {"a_date": "d/M/yyyy"}).collect()]
    assert [g is not None for g in got] == [False] * 8 + [True, True]


def test_a_date_is_read_by_few_patterns(spark):
    values = ["5 March 2024", "mar 5, 24 1:30 pm", "20240305 12:05:09.5 am", "05/03/69", "5.3.68 25:00 PM", "30 feb 2024",
              "5 marc 2024", "0000-01-01"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    read = df.select(safe_timestamp(F.col("v"), T.StringType(), "d/M/yyyy").cast("string").alias("t"))
    assert [r.t for r in read.collect()] == [
        "2024-03-05 00:00:00", "2024-03-05 13:30:00", "2024-03-05 00:05:09.5", "1969-03-05 00:00:00",
        "2068-03-05 13:00:00", None, None, "0000-01-01 00:00:00"]
    plan = read._jdf.queryExecution().analyzed().toString()
    assert sum(plan.count(f) for f in ("RLIKE", "regexp_extract(", "regexp_replace(")) <= 30
