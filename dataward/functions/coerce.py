"""Lenient conversions: a bad value becomes null, never an error."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataward.constants import NA_TOKENS

# Text accepted as a number, a whole number and a point in time. Patterns
# are tested first: a cast that fails is far slower than a pattern that does not match.
NUMBER_TEXT = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)
WHOLE_TEXT = r"^\s*[+-]?\d{1,19}\s*$"
TIME_TEXT = r"^\s*\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d{1,6})?)?\s*$"
# The same with slashes, without seconds or with a zone; and days or months first.
LOOSE_TIME_TEXT = (r"^\s*\d{4}[-/]\d{2}[-/]\d{2}"
                   r"([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$")
SLASHED_DATE = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
# Other dates, each with an optional time of day (hour, minute, second, fraction, half of the
# day). Only the last kind has two readings.
CLOCK = r"(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?)?\s*([AaPp][Mm])?)?\s*$"
# the group holds the first three letters
MONTH_NAME = ("((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
              "(?i:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust"
              "|(?<=sep)tember|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?")
YEAR_FIRST = r"^\s*(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + CLOCK
COMPACT = r"^\s*(\d{4})(\d{2})(\d{2})" + CLOCK
DAY_NAMED_MONTH = r"^\s*(\d{1,2})[-/ ]?" + MONTH_NAME + r"[-/ ,.]*(\d{4}|\d{2})" + CLOCK
NAMED_MONTH_DAY = r"^\s*" + MONTH_NAME + r"[-/ .]*(\d{1,2})(?:,\s*|[-/ ]+)(\d{4}|\d{2})" + CLOCK
NUMERIC_ORDER = r"^\s*(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})" + CLOCK
# NUMERIC_ORDER with a first or second number that can be the month and another that can be the day
_MONTH, _DAY = r"^\s*(0?[1-9]|1[0-2])([-/.])", r"^\s*(0?[1-9]|[12]\d|3[01])([-/.])"
MONTH_THEN_DAY = _MONTH + r"(0?[1-9]|[12]\d|3[01])\2(\d{4}|\d{2})" + CLOCK
DAY_THEN_MONTH = _DAY + r"(0?[1-9]|1[0-2])\2(\d{4}|\d{2})" + CLOCK
# The time of day of a text that ends in CLOCK: hour, minute, second, fraction.
END_CLOCK = r"^[^:]*[ T](\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,6})?)?\s*(?:[AaPp][Mm])?\s*$"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
OLD_YEAR, NEW_YEAR = r"^(69|[7-9]\d)-", r"^(\d\d)-"    # two-digit years from 69 on belong to the nineteen hundreds
DAY_FIRST, MONTH_FIRST = "d/M/yyyy", "M/d/yyyy"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col(quoted(name))


def profile_dtype(data_type: T.DataType) -> str:
    """int, float, datetime, boolean, object, or the type's own name when unsupported."""
    if isinstance(data_type, INTEGRAL):
        return "int"
    if isinstance(data_type, NUMERIC):
        return "float"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.StringType):
        return "object"
    return data_type.simpleString()


def safe_double(value: Column, data_type: T.DataType) -> Column:
    """Number or null. NaN counts as null."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        number = value.cast("double")
        return F.when(~F.isnan(number), number)
    if isinstance(data_type, NUMERIC):
        return value.cast("double")
    if isinstance(data_type, T.StringType):
        return F.when(value.rlike(NUMBER_TEXT), value.try_cast("double"))
    return F.lit(None).cast("double")


def quoted(name: str) -> str:
    """The column's name as it is written in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """The text as it is written in a SQL expression."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _time_of_day(value: Column) -> Column:
    """The time of day at the end of a text that has been found to end in CLOCK, as text after
    a blank; empty without one."""
    hour = F.regexp_extract(value, END_CLOCK, 1)
    of_day = F.when(value.rlike(r"[Mm]\s*$"), (F.pmod(hour.try_cast("int"), F.lit(12)) + F.when(
        value.rlike(r"[Pp][Mm]\s*$"), 12).otherwise(0)).cast("string")).otherwise(hour)
    # the second is missing or two digits
    rest = F.replace(F.regexp_replace(value, END_CLOCK, ":$2:<$3>$4"), F.lit("<>"), F.lit("00"))
    return F.when(F.call_function("instr", value, F.lit(":")) == 0, F.lit("")).otherwise(
        F.concat(F.lit(" "), of_day, F.translate(rest, "<>", "")))


def _apart(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` as a lambda function. The value is computed once; and long expressions of many
    columns stay out of the stage's one generated method, which the JVM would not compile."""
    return F.transform(F.array(value), f)[0]


def _moment(value: Column, layout: str | None) -> Column:
    """A text as ``safe_timestamp`` reads it: it is rewritten to ISO 8601 by one replacement for
    its date and one for its time of day, and cast once."""
    dashed = F.regexp_replace(F.trim(value), r"^(\d{4})/(\d{2})/(\d{2})", "$1-$2-$3")
    full = F.regexp_replace(dashed, r"^(\S{10}[ T]\d{2}:\d{2})(?!:)", "$1:00")
    place = F.call_function("instr", F.lit(MONTHS), F.lower(F.regexp_extract(value, MONTH_NAME, 1)))
    month = ((place + 2) / 3).cast("int").cast("string")
    def date(pattern: str, parts: str) -> tuple[Column, Column]:
        return value.rlike(pattern), F.regexp_replace(value, pattern, parts)

    layouts = [date(YEAR_FIRST, "$1-$3-$4"), date(COMPACT, "$1-$2-$3")]
    if layout:
        layouts.insert(0, date(NUMERIC_ORDER, "$4-$3-$1" if layout == DAY_FIRST else "$4-$1-$3"))
    for pattern, parts in ((DAY_NAMED_MONTH, "$3-m-$1"), (NAMED_MONTH_DAY, "$3-m-$2")):
        found, named = date(pattern, parts)
        layouts.append((found, F.replace(named, F.lit("m"), month)))
    day = reduce(lambda done, x: done.when(*x), layouts, F)
    day = F.regexp_replace(F.regexp_replace(day, OLD_YEAR, "19$1-"), NEW_YEAR, "20$1-")
    return (F.when(value.rlike(TIME_TEXT), value).when(value.rlike(LOOSE_TIME_TEXT), full)
            .otherwise(F.concat(day, _time_of_day(value)))).try_cast("timestamp")


def safe_timestamp(value: Column, data_type: T.DataType, layout: str | None = None) -> Column:
    """Timestamp or null. Only strings are parsed: ISO 8601 and its variants, the year first,
    eight digits, and months by name. Dates of two numbers and a year are read only in
    ``layout``, day or month first, whatever stands between the numbers."""
    if isinstance(data_type, TEMPORAL):
        return value.cast("timestamp")
    if isinstance(data_type, T.StringType):
        return _apart(value, lambda text: _moment(text, layout))
    return F.lit(None).cast("timestamp")


def _date_texts(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """Text columns named like a date; of those only ``columns``, if given."""
    wanted = None if columns is None else set(columns)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and looks_like_date(f.name)
            and (wanted is None or f.name in wanted)]


def slashed_orders(df: DataFrame) -> DataFrame:
    """(column_name, slashed, day_first, month_first, layout) of text columns named like a
    date, from one aggregate: a first or second number above 12 shows which one is the day.
    Without such a value, or with both kinds, the layout is null: it is not guessed."""
    names = _date_texts(df, None)
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column_name string, slashed bigint, day_first bigint, month_first bigint, layout string")

    def above(name: str, group: int) -> Column:
        # a text that does not match has no number to convert: failing conversions are slow
        return F.when(col(name).rlike(SLASHED_DATE), F.regexp_extract(col(name), SLASHED_DATE, group).cast("int") > 12)

    counts = [F.struct(F.lit(n).alias("column_name"), F.count_if(col(n).rlike(SLASHED_DATE)).alias("slashed"),
                       F.count_if(above(n, 1)).alias("day_first"), F.count_if(above(n, 2)).alias("month_first"))
              for n in names]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c")).withColumn(
        "layout", F.when((F.col("day_first") > 0) & (F.col("month_first") == 0), DAY_FIRST)
        .when((F.col("month_first") > 0) & (F.col("day_first") == 0), MONTH_FIRST))


READINGS = ("column_name string, two_numbers bigint, day_first bigint, month_first bigint, other_dates bigint, "
            "layout string, ambiguous boolean")


def date_readings(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """How text columns named like a date are read: one row per column, from one aggregate.

    Every value of two numbers and a year rules out the orders that cannot read it, and what
    is left over all of them is the column's order. ``day_first`` and ``month_first`` count the
    values that allow one order only, ``other_dates`` those of the layouts with one reading.
    A column whose values allow both orders is ambiguous: if it holds no other dates, months
    are read first, as a reader without further knowledge does; beside other dates such values are not read. If
    the values of a column contradict each other, none of them is."""
    names = _date_texts(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], READINGS)
    other = "|".join(f"(?:{p})" for p in (TIME_TEXT, LOOSE_TIME_TEXT, YEAR_FIRST.replace(r"\2", r"[-/.]"), COMPACT,
                                          DAY_NAMED_MONTH, NAMED_MONTH_DAY))

    def orders(name: str) -> Column:
        """Bit 1: the day can be first, bit 2: the month can; null for other texts."""
        day, month = (F.when(col(name).rlike(p), bit).otherwise(0)
                      for p, bit in ((DAY_THEN_MONTH, 1), (MONTH_THEN_DAY, 2)))
        return F.when(~col(name).rlike(TIME_TEXT) & col(name).rlike(NUMERIC_ORDER), day + month)

    bits = df.select(*[F.struct(orders(n).alias("bits"),
                                (F.col(quoted(n)).rlike(TIME_TEXT) | col(n).rlike(other)).alias("other")).alias(f"c{i}")
                       for i, n in enumerate(names)])
    counts = [F.struct(F.lit(n).alias("column_name"), F.count_if(F.col(f"c{i}.bits") > 0).alias("two_numbers"),
                       F.count_if(F.col(f"c{i}.bits") == 1).alias("day_first"),
                       F.count_if(F.col(f"c{i}.bits") == 2).alias("month_first"),
                       F.count_if(F.col(f"c{i}.other")).alias("other_dates"),
                       # what all of them allow; values that no order reads say nothing
                       F.bit_and(F.when(F.col(f"c{i}.bits") > 0, F.col(f"c{i}.bits"))).alias("all"))
              for i, n in enumerate(names)]
    allowed = F.coalesce("all", F.lit(0))
    return (bits.agg(F.array(*counts).alias("c")).select(F.inline("c"))
            .withColumn("layout", F.when(allowed == 1, DAY_FIRST).when(allowed == 2, MONTH_FIRST)
                        .when((allowed == 3) & (F.col("other_dates") == 0), MONTH_FIRST))
            .withColumn("ambiguous", (allowed == 3) | (F.col("two_numbers") > 0) & (allowed == 0))
            .select([c.split()[0] for c in READINGS.split(", ")]))


def date_layouts(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """The orders that columns settle, by column name: one aggregate, if there is a text
    column named like a date among ``columns`` (None: all)."""
    if not _date_texts(df, columns):
        return {}
    return {r.column_name: r.layout for r in date_readings(df, columns).collect() if r.layout}   # one row per column


def seen(value: Column, name: str, data_type: T.DataType, layout: str | None = None) -> Column:
    """The value as the profile reads it: NaN and, in text columns named like a date, text
    that is no date are null."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    if isinstance(data_type, T.StringType) and looks_like_date(name):
        return safe_timestamp(value, data_type, layout)
    return value


def strip(value: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def looks_like_date(name: str) -> bool:
    return "date" in name.lower() or "time" in name.lower()


def parse_dates(df: DataFrame, layouts: dict[str, str] | None = None) -> DataFrame:
    """String columns named like a date become timestamps; unparseable text becomes null.

    ``layouts`` gives a column's order of numeric dates, as ``date_readings`` finds it."""
    parsed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and looks_like_date(f.name):
            parsed[f.name] = safe_timestamp(col(f.name), f.dataType, (layouts or {}).get(f.name))
    return df.withColumns(parsed) if parsed else df


def null_tokens(df: DataFrame) -> DataFrame:
    """String cells holding a null token become null."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~col(c).isin(NA_TOKENS), col(c)) for c in strings})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats})


HEAD_ROWS = 1000


def _conversions(name: str) -> dict[str, tuple[Column, Column]]:
    """Per type, narrowest first: (test that a value converts, the converted value)."""
    c = col(name)
    number = safe_double(c, T.StringType())
    whole = F.when(c.rlike(WHOLE_TEXT), c.try_cast("bigint"))
    return {
        "bigint": (whole.isNotNull(), F.trim(c).cast("bigint")),
        "double": (number.isNotNull(), number),
        "boolean": (F.lower(c).isin("true", "false"), F.lower(c).cast("boolean")),
    }


def infer_types(df: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Give all-string columns the narrowest type that converts all their non-null values:
    bigint, double, boolean or string.

    Types that the first rows already rule out are not tried again, so the one aggregate
    over the whole table only tests what is still possible. ``drop_empty`` also leaves out
    columns without any value."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    options = {c: _conversions(c) for c in strings}

    def misses(table: DataFrame, wanted: dict[str, list[str]]):
        """Per column its number of values and, per wanted type, of values that fail."""
        return table.agg(*[F.struct(F.count(col(c)).alias("n"), *[
            F.count_if(col(c).isNotNull() & ~options[c][t][0]).alias(t) for t in types])
            .alias(f"c{i}") for i, (c, types) in enumerate(wanted.items())]).first()

    head = misses(df.limit(HEAD_ROWS), {c: list(options[c]) for c in strings})
    possible = {c: [t for t in options[c] if head[i][t] == 0] for i, c in enumerate(strings)}
    found = misses(df, possible)
    typed, empty = {}, []
    for i, c in enumerate(strings):
        if found[i].n == 0:
            empty.append(c)
            continue
        fits = [t for t in possible[c] if found[i][t] == 0]
        if fits:
            typed[c] = options[c][fits[0]][1]
    kept = [c for c in df.columns if not (drop_empty and c in empty)]
    return df.select([typed.get(c, col(c)).alias(c) for c in kept])
