"""Detection of personal data by column name, by value pattern and by value shape."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataward.constants import PATTERN_BOUND_TYPES, PII_PATTERNS, PII_SAMPLES
from dataward.functions.coerce import col, profile_dtype, strip
from dataward.functions.names import pii_type_of_name
from dataward.operators.profile import PROFILED

BOUND_ROWS = 1000        # rows looked at to bound the samples from above
BOUND_PREFIX = 64        # characters of each value used for that
HIGHEST = chr(0x10FFFF)


COLUMNS = "table_name string, column_name string, ordinal int"
SAMPLES = "table_name string, column_name string, rank int, value string"


def columns_of(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, ordinal) of one table."""
    rows = [(table, f.name, i) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, COLUMNS)


def sample_distinct(df: DataFrame, table: str, k: int = PII_SAMPLES) -> DataFrame:
    """The k smallest distinct non-empty values per column: (table_name, column_name,
    rank, value).

    Rows drawn from the whole table give, per column, a value that at least k distinct
    values do not exceed, however the table is sorted. Only values up to it can be among
    the k smallest, so nearly all rows drop out in the scan and the exact distinct step
    that follows is small. A column without such a bound shows fewer than k values in
    `BOUND_ROWS` rows; equal values combine map-side."""
    names = [f.name for f in df.schema.fields if profile_dtype(f.dataType) in PROFILED]
    if not names:
        return df.sparkSession.createDataFrame([], SAMPLES)
    text = {n: col(n).cast("string") for n in names}
    bounds = _upper_bounds(df, text, k)
    kept = df.select([
        (text[n] if n not in bounds else F.when(text[n] <= F.lit(bounds[n]), text[n])).alias(n)
        for n in names])
    distinct = (kept.unpivot([], [col(n) for n in names], "column_name", "value")
                .where(F.col("value") != "").distinct())
    w = Window.partitionBy("column_name").orderBy("value")
    return (distinct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.lit(table).alias("table_name"), "column_name", "rank", "value"))


def _upper_bounds(df: DataFrame, text: dict[str, Column], k: int) -> dict[str, str]:
    """Per column a text at least k distinct values do not exceed, from a few short
    prefixes. A prefix followed by the highest character is not below the whole value."""
    head = df.select([F.left(c, F.lit(BOUND_PREFIX)).alias(n) for n, c in text.items()]
                     ).orderBy(F.rand(seed=11)).limit(BOUND_ROWS).collect()
    bounds = {}
    for i, name in enumerate(text):
        seen = sorted({r[i] for r in head if r[i]}, key=lambda v: v.encode("utf-8"))
        if len(seen) >= k:
            bounds[name] = seen[k - 1] + HIGHEST
    return bounds


def _pattern_hit(pii_type: Column, value: Column) -> Column:
    text = strip(value)
    chain = F.when(F.lit(False), F.lit(False))
    for name, pattern in PII_PATTERNS.items():
        chain = chain.when(pii_type == name, text.rlike("(?U)" + pattern))
    return F.coalesce(chain, F.lit(False))


def _share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def score_columns(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per column: keyword type, pattern score of its samples, value-shape type."""
    typed = columns.withColumn("keyword_type", pii_type_of_name(F.col("column_name")))
    joined = typed.join(samples, ["table_name", "column_name"], "left")
    value, found = F.col("value"), F.col("value").isNotNull()
    hit = _pattern_hit
    scored = joined.groupBy("table_name", "column_name", "ordinal", "keyword_type").agg(
        F.count("value").alias("samples"),
        _share(hit(F.col("keyword_type"), value)).alias("keyword_score"),
        _share(found & value.contains("@") & value.contains(".")).alias("email_shape"),
        _share(found & hit(F.lit("PHONE"), value)).alias("phone_score"),
        _share(found & hit(F.lit("EMAIL"), value)).alias("email_score"),
        F.coalesce(F.bool_and(F.when(
            found & (F.col("rank") <= 5),
            F.replace(value, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$"))), F.lit(False))
        .alias("alphabetic"),
        F.transform(F.array_sort(F.collect_list(F.when(
            F.col("rank") <= 5, F.struct("rank", "value")))), lambda s: s["value"])
        .alias("sample_values"))
    any_sample = F.col("samples") > 0
    shape = (F.when(any_sample & (F.col("email_shape") > 0.5), "EMAIL")
             .when(any_sample & (F.col("phone_score") > 0.5), "PHONE")
             .when(any_sample & F.lower("column_name").rlike("name|naam")
                   & F.col("alphabetic"), "NAME"))
    shape_score = (F.when(shape == "EMAIL", F.col("email_score"))
                   .when(shape == "PHONE", F.col("phone_score")).otherwise(0.0))
    return scored.select(
        "table_name", "column_name", "ordinal", "samples", "sample_values", "keyword_type",
        "keyword_score",
        F.when(F.col("keyword_type").isNull(), shape).alias("shape_type"),
        shape_score.alias("shape_score"))


def detections(scores: DataFrame) -> DataFrame:
    """Columns judged personal, with confidence and how they were found."""
    keyword, k, s = F.col("keyword_type"), F.col("keyword_score"), F.col("shape_score")
    by_name = keyword.isNotNull()
    sampled = F.col("samples") > 0
    confirmed = by_name & sampled & (k > 0.3)
    refuted = by_name & sampled & (k == 0) & keyword.isin(PATTERN_BOUND_TYPES)
    shaped = F.col("shape_type").isNotNull()
    confidence = (F.when(confirmed, F.least(F.lit(0.95), 0.7 + k * 0.3))
                  .when(refuted, 0.4)
                  .when(by_name, 0.7)
                  .when(s > 0.3, F.least(F.lit(0.90), 0.6 + s * 0.3))
                  .otherwise(0.6))
    method = (F.when(confirmed, "keyword+regex").when(refuted, "keyword_only")
              .when(by_name, "keyword").when(s > 0.3, "semantic+regex")
              .otherwise("semantic"))
    return scores.where(by_name | shaped).select(
        "table_name", "column_name", "ordinal",
        F.coalesce("keyword_type", "shape_type").alias("pii_type"),
        F.round(confidence, 2).alias("confidence"), method.alias("detection_method"),
        "sample_values")


def columns_and_samples(tables: dict[str, DataFrame],
                        parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """All columns of the tables and their samples; the small first reads run side by
    side."""
    if not tables:
        spark = SparkSession.active()
        return spark.createDataFrame([], COLUMNS), spark.createDataFrame([], SAMPLES)
    with ThreadPoolExecutor(parallel) as pool:
        samples = list(pool.map(lambda t: sample_distinct(t[1], t[0]), tables.items()))
    columns = [columns_of(df, name) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, columns), reduce(DataFrame.unionByName, samples)


def detect_pii(tables: dict[str, DataFrame]) -> DataFrame:
    """Detections over all columns of all given tables."""
    return detections(score_columns(*columns_and_samples(tables)))


def lineage_tables(spark: SparkSession, edges: DataFrame) -> dict[str, DataFrame]:
    """The catalog tables that the edges name; tables that cannot be read are left out."""
    names = (edges.select(F.explode(F.array("src_table", "tgt_table")).alias("t")).distinct())
    known = {t.name for t in spark.catalog.listTables()}
    found = names.where(F.col("t").isin(list(known))).collect()
    tables = {}
    for row in sorted(found, key=lambda r: r.t):
        try:
            tables[row.t] = spark.table(row.t)
        except Exception:
            continue
    return tables
