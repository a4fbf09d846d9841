"""Column profiles: one row per column of a table.

First one global aggregate counts, bounds and moments, without a shuffle of rows; its
result is one row per column. Distinct counts, quartiles and top values of all columns then
come from one table of (column, value) frequencies: one more scan and one shuffle, combined
map-side, so a hot value leaves each task as one row. The rows of a table of more than
`TASK_ROWS` are dealt out before, so that no task combines more than about that many, however
many of them a file's row group holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataward.constants import CATEGORY_VALUES, TOP_VALUES
from dataward.functions.coerce import (
    TEMPORAL,
    col,
    date_layouts,
    nan_to_null,
    parse_dates,
    profile_dtype,
    quoted,
    text_literal,
)
from dataward.operators.quantile import GROUP_LIMIT, Extent, exact_quantiles
from dataward.session import materialize

COLUMNS_PER_SCAN = 200
TASK_ROWS = 250_000       # rows whose values one task combines
LONG_VALUE = 256          # longer strings are grouped by digest, never by their text
TOP_TYPE = "array<struct<value:string,n:bigint>>"
STATS_SCHEMA = (
    "column_name string, ordinal int, dtype string, total_count bigint, null_count bigint, "
    "min_value double, max_value double, mean double, std double, min_ts timestamp, "
    "max_ts timestamp, negative_count bigint, zero_count bigint, future_date_count bigint, "
    "has_empty_strings bigint, valid_email_count bigint, invalid_email_count bigint, "
    "longest int, sketch_count bigint, sketch_p25 double, sketch_p75 double")


def profile(df: DataFrame, dataset: str = "dataset", as_of: str | None = None,
            sample_rows: int | None = None, approx: bool = False,
            group_limit: int = GROUP_LIMIT, layouts: dict[str, str] | None = None) -> DataFrame:
    """Profile table of one dataset.

    ``layouts`` of numeric dates, by column, are found in the table if not given.

    ``sample_rows`` profiles a Bernoulli sample of about that many rows (off by default).
    ``approx`` replaces exact distinct counts and quartiles by mergeable sketches.
    """
    layouts = date_layouts(df) if layouts is None else layouts
    table = parse_dates(nan_to_null(df), layouts)
    total, sampled = None, False
    if sample_rows is not None:
        total = table.count()
        sampled = total > sample_rows
        if sampled:
            table = table.sample(fraction=sample_rows / total, seed=42)
    if table.dtypes != df.dtypes and all(profile_dtype(f.dataType) in PROFILED for f in table.schema.fields):
        # dates are read from text once, not in both scans, and by all tasks, not one per row group
        dealt = df.repartition(F.xxhash64(*[col(c) for c in df.columns]))
        table = materialize(parse_dates(nan_to_null(dealt), layouts), "parsed")
    rows = column_stats(table, as_of, approx).collect()          # one row per column
    stats = df.sparkSession.createDataFrame(rows, STATS_SCHEMA)
    longest = {r.column_name: r.longest for r in rows if r.longest is not None}
    if total is None:
        total = rows[0].total_count if rows else 0
    extents = {r.column_name: Extent(r.total_count - r.null_count, r.min_value, r.max_value)
               for r in rows}
    pieces = _distinct_pieces(table, longest, extents, approx, group_limit,
                              rows[0].total_count if rows else 0)
    if pieces:
        merged = reduce(DataFrame.unionByName, pieces).groupBy("column_name").agg(
            *[F.max(c).alias(c) for c in ("unique_count", "p25", "p75", "tops")])
        stats = stats.join(F.broadcast(merged), "column_name", "left")
    else:
        stats = stats.selectExpr("*", "0L AS unique_count", "double(NULL) AS p25",
                                 "double(NULL) AS p75", f"cast(NULL AS {TOP_TYPE}) AS tops")
    unique = "coalesce(unique_count, sketch_count, 0L)"
    return stats.selectExpr(
        f"{text_literal(dataset)} AS dataset", "column_name", "ordinal", "dtype",
        "total_count", "null_count",
        "round(null_count / greatest(total_count, 1) * 100, 2) AS null_pct",
        f"{unique} AS unique_count",
        f"round({unique} / greatest(total_count, 1) * 100, 2) AS unique_pct",
        "min_value", "max_value", "round(mean, 4) AS mean", "round(std, 4) AS std",
        "round(coalesce(p25, sketch_p25), 4) AS p25",
        "round(coalesce(p75, sketch_p75), 4) AS p75", "negative_count", "zero_count",
        "date_format(min_ts, 'yyyy-MM-dd HH:mm:ss') AS min_date",
        "date_format(max_ts, 'yyyy-MM-dd HH:mm:ss') AS max_date", "future_date_count",
        "round(try_divide(future_date_count, total_count - null_count) * 100, 2) "
        "AS future_date_pct",
        "has_empty_strings", "valid_email_count", "invalid_email_count",
        f"slice(tops, 1, {TOP_VALUES}) AS top_values",
        # complete, or null: rules may rely on it
        f"CASE WHEN size(tops) <= {CATEGORY_VALUES} THEN tops END AS category_values",
        f"{str(sampled).lower()} AS sampled", f"{total}L AS total_rows",
        "total_count AS profiled_rows")


def column_stats(df: DataFrame, as_of: str | None = None, approx: bool = False) -> DataFrame:
    """Counts, bounds and moments of every column from one global aggregate; very wide
    tables take one aggregate per group of columns, each reading only those."""
    names = [c.split()[0] for c in STATS_SCHEMA.split(", ")]
    types = dict(c.split() for c in STATS_SCHEMA.split(", "))
    structs = []
    for i, f in enumerate(df.schema.fields):
        found = _stats_sql(f, i, as_of, approx)
        structs.append("struct(" + ", ".join(
            f"cast({found.get(n, 'NULL')} AS {types[n]}) AS {n}" for n in names) + ")")
    return reduce(DataFrame.unionByName, [
        df.selectExpr(f"array({', '.join(structs[i:i + COLUMNS_PER_SCAN])}) AS s")
        .selectExpr("inline(s)") for i in range(0, len(structs), COLUMNS_PER_SCAN)])


def profile_tables(tables: dict[str, DataFrame], as_of: str | None = None,
                   parallel: int = 4, **options) -> DataFrame:
    """Profiles of many tables, one row per column. Their first aggregates are submitted
    side by side, the rest is one job."""
    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(
            lambda item: profile(item[1], item[0], as_of, **options), tables.items()))
    return reduce(DataFrame.unionByName, parts)


def _stats_sql(field: T.StructField, ordinal: int, as_of: str | None,
               approx: bool) -> dict[str, str]:
    """The aggregates that apply to this kind of column."""
    c, kind = quoted(field.name), profile_dtype(field.dataType)
    out = {"column_name": text_literal(field.name), "ordinal": str(ordinal),
           "dtype": text_literal(kind), "total_count": "count(1)",
           "null_count": f"count(1) - count({c})"}
    if kind in ("int", "float"):
        out |= {"min_value": f"min({c})", "max_value": f"max({c})", "mean": f"avg({c})",
                "std": f"stddev_samp({c})", "negative_count": f"count_if({c} < 0)",
                "zero_count": f"count_if({c} = 0)"}
        if approx:
            out |= {"sketch_p25": f"percentile_approx({c}, 0.25)",
                    "sketch_p75": f"percentile_approx({c}, 0.75)"}
    elif kind == "datetime":
        now = "current_timestamp()" if as_of is None else f"timestamp {text_literal(as_of)}"
        out |= {"min_ts": f"min({c})", "max_ts": f"max({c})",
                "future_date_count": f"count_if({c} > {now})"}
    elif kind == "object":
        out |= {"has_empty_strings": f"count_if({c} = '')", "longest": f"max(length({c}))"}
        if "mail" in field.name.lower():
            mail = f"{c} RLIKE '@.*[.]'"
            out |= {"valid_email_count": f"count_if({mail})",
                    "invalid_email_count": f"count_if(NOT {mail})"}
    if approx and kind in PROFILED:
        out["sketch_count"] = f"approx_count_distinct({c})"
    return out


PROFILED = ("int", "float", "datetime", "boolean", "object")
TEXTS = ("object", "boolean")


def _distinct_pieces(df: DataFrame, longest: dict[str, int], extents: dict[str, Extent],
                     approx: bool, group_limit: int, total: int) -> list[DataFrame]:
    """(column_name, unique_count, p25, p75, tops) from one table of value frequencies.

    Every part reads n, and filters columns by an expression of n, so that all of them stand on
    the same aggregate and its one shuffle."""
    no_top, no_quartiles = f"cast(NULL AS {TOP_TYPE}) AS tops", [
        "double(NULL) AS p25", "double(NULL) AS p75"]
    kinds = {f.name: profile_dtype(f.dataType) for f in df.schema.fields}
    names = [n for n, k in kinds.items() if k in PROFILED and (not approx or k in TEXTS)]
    if not names:
        return []
    freq, pieces = _frequencies(df, names, longest, total), []
    numbers = {i: extents[n] for i, n in enumerate(names) if kinds[n] in ("int", "float") and extents[n].n}
    if not approx:
        if max((e.n for e in numbers.values()), default=0) > group_limit:
            freq = materialize(freq, "value-counts")
        pieces.append(freq.groupBy("column_id").agg(F.count_if(F.col("n") > 0).alias("unique_count"))
                      .selectExpr(_name_of(names), "unique_count", *no_quartiles, no_top))
    if numbers and not approx:
        # decimals are counted exactly, as text; for quartiles they are doubles like the rest
        value = F.coalesce("real", F.col("whole").cast("double"), F.col("text").try_cast("double"))
        pieces.append(exact_quantiles(
            _of(freq, numbers).select("column_id", value.alias("value"), "n"), numbers,
            [0.25, 0.75], ["p25", "p75"], group_limit)
            .selectExpr(_name_of(names), "bigint(NULL) AS unique_count", "p25", "p75", no_top))
    texts = [i for i, n in enumerate(names) if kinds[n] in TEXTS]
    if texts:
        tops = _top_of(df, names, _of(freq, texts), longest, CATEGORY_VALUES + 1).groupBy("column_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                        lambda t: F.struct(t["value"].alias("value"), t["n"].alias("n")))
            .alias("tops"))
        pieces.append(tops.selectExpr(_name_of(names), "bigint(NULL) AS unique_count",
                                      *no_quartiles, "tops"))
    return pieces


def _of(freq: DataFrame, columns: Iterable[int]) -> DataFrame:
    """The frequencies of some columns; the filter stays above the aggregate."""
    return freq.where(F.when(F.col("n") > 0, F.col("column_id")).isin(list(columns)))


def _name_of(names: list[str]) -> str:
    return f"array({', '.join(text_literal(n) for n in names)})[column_id] AS column_name"


def _is_long(name: str, longest: dict[str, int]) -> bool:
    return (longest.get(name) or 0) > LONG_VALUE


def _frequencies(df: DataFrame, names: list[str], longest: dict[str, int], total: int) -> DataFrame:
    """(column_id, whole, real, text, is_digest, n) per different value of the named columns of
    ``total`` rows, nulls left out; the id is the position in ``names``. One of the three holds the value:
    whole numbers and points in time (as microseconds), other numbers, texts (also of
    booleans and decimals). Long texts are counted by their digest, so whole documents never
    reach the shuffle."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells, rows = [], []
    for i, name in enumerate(names):
        c, kind = quoted(name), profile_dtype(types[name])
        value, v = f"cast({c} AS string)", f"c{i}"
        whole, real, text, digest = "bigint(NULL)", "double(NULL)", "string(NULL)", "false"
        if isinstance(types[name], TEMPORAL):
            value, whole = f"unix_micros(cast({c} AS timestamp))", v
        elif kind == "int":
            value, whole = f"cast({c} AS bigint)", v
        elif kind == "float" and not isinstance(types[name], T.DecimalType):
            value, real = f"cast({c} AS double)", v
        elif _is_long(name, longest):
            value = (f"CASE WHEN length({c}) > {LONG_VALUE} THEN struct(sha2({c}, 256) AS text, true AS is_digest) "
                     f"ELSE struct({c} AS text, false AS is_digest) END")
            text, digest = f"{v}.text", f"{v}.is_digest"
        else:
            text = v
        cells.append(f"{value} AS {v}")
        rows.append(f"{i}, {whole}, {real}, {text}, {digest}")
    table = df.selectExpr(cells)
    if total > TASK_ROWS:
        tasks = max(math.ceil(total / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
        table = table.repartition(tasks, F.xxhash64(*table.columns))
    return (table.selectExpr(f"stack({len(names)}, {', '.join(rows)}) AS (column_id, whole, real, text, is_digest)")
            # the join with extents would ask for a column_id in its own copy, and get a scan of its own
            .where("column_id IS NOT NULL AND (whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL)")
            .groupBy("column_id", "whole", "real", "text", "is_digest").agg(F.count(F.lit(1)).alias("n")))


def _top_of(df: DataFrame, names: list[str], counts: DataFrame, longest: dict[str, int],
            k: int) -> DataFrame:
    """The k most frequent values per column, ties in the order of the values' digests,
    whatever their length: (column_id, rank, value, n). The rank filter runs before the
    shuffle."""
    digest = F.when(F.col("is_digest"), F.col("text")).otherwise(F.sha2("text", 256))
    w = Window.partitionBy("column_id").orderBy(F.desc("n"), digest)
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    short = ranked.where("NOT is_digest").selectExpr("column_id", "rank", "text AS value", "n")
    wide = [(i, n) for i, n in enumerate(names) if _is_long(n, longest)]
    if not wide:
        return short
    # Fetch the text behind the few winning digests: at most k per column are broadcast.
    digests = ranked.where("is_digest").select("column_id", F.col("text").alias("key"), "rank", "n")
    pairs = ", ".join(f"{i}, {quoted(n)}" for i, n in wide)
    texts = df.selectExpr(f"stack({len(wide)}, {pairs}) AS (column_id, value)").where(f"length(value) > {LONG_VALUE}")
    restored = (texts.withColumn("key", F.sha2("value", 256))
                .join(F.broadcast(digests), ["column_id", "key"])
                .groupBy("column_id", "rank", "n").agg(F.min("value").alias("value"))
                .select("column_id", "rank", "value", "n"))
    return short.unionByName(restored)


def sample_values(df: DataFrame, key: str, k: int = 3) -> DataFrame:
    """First k non-null values per text column in key order: (column_name, rank, value).

    Each column is a top-k by key: k rows per task, no shuffle of the table."""
    parts = [df.sparkSession.createDataFrame([], T.StructType([
        T.StructField("column_name", T.StringType()),
        T.StructField("k", df.schema[key].dataType), T.StructField("value", T.StringType())]))]
    for f in df.schema.fields:
        if profile_dtype(f.dataType) != "object" or f.name == key:
            continue
        head = (df.where(col(f.name).isNotNull()).select(col(key).alias("k"),
                                                         col(f.name).alias("value"))
                .orderBy("k").limit(k))
        parts.append(head.select(F.lit(f.name).alias("column_name"), "k", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("column_name").orderBy("k")
    return out.select("column_name", F.row_number().over(w).alias("rank"), "value")


def null_rate(profiles: DataFrame) -> DataFrame:
    """Share of null cells per dataset, in percent."""
    return profiles.groupBy("dataset").agg(
        F.sum("null_count").alias("null_cells"),
        F.sum("total_count").alias("cells"),
        F.round(F.try_divide(F.sum("null_count"), F.sum("total_count")) * 100, 4)
        .alias("null_rate_pct"))


def dataset_info(df: DataFrame, dataset: str, key: str, rows: int = 3) -> DataFrame:
    """Row count, column count, column list, types and the first rows by key as JSON."""
    names = ",".join(df.columns)
    types = ",".join(f"{f.name}:{profile_dtype(f.dataType)}" for f in df.schema.fields)
    head = (df.orderBy(col(key)).limit(rows)
            .agg(F.array_sort(F.collect_list(F.struct(
                col(key).alias("k"), F.to_json(F.struct("*")).alias("row")))).alias("h"))
            .select(F.transform("h", lambda r: r["row"]).alias("sample_rows")))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset).alias("dataset"), "row_count",
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(names).alias("columns"), F.lit(types).alias("dtypes"),
        head.scalar().alias("sample_rows"))
