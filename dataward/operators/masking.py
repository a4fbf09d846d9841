"""Masking whole tables: one projection per table, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataward.functions.coerce import col
from dataward.functions.masks import mask


def types_by_table(detections: DataFrame) -> dict[str, dict[str, str]]:
    """table -> column -> type. A detection table has one row per sensitive column."""
    found: dict[str, dict[str, str]] = {}
    for r in detections.select("table_name", "column_name", "pii_type").collect():
        found.setdefault(r.table_name, {})[r.column_name] = r.pii_type
    return found


def mask_table(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table with the given columns masked as their type asks."""
    return df.withColumns({c: mask(col(c), t) for c, t in types.items() if c in df.columns})


def mask_tables(tables: dict[str, DataFrame], detections: DataFrame) -> dict[str, DataFrame]:
    """Every table with at least one detection, masked."""
    found = types_by_table(detections)
    return {name: mask_table(df, found[name]) for name, df in tables.items() if name in found}


def masking_details(df: DataFrame, types: dict[str, str], key: str, table: str,
                    k: int = 3) -> DataFrame:
    """Per masked column its first k non-null values in key order, before and after."""
    parts = [df.sparkSession.createDataFrame([], T.StructType(
        [T.StructField(n, T.StringType()) for n in ("table_name", "column_name", "pii_type")]
        + [T.StructField("k", df.schema[key].dataType)]
        + [T.StructField(n, T.StringType()) for n in ("before", "after")]))]
    for c, t in types.items():
        if c not in df.columns:
            continue
        head = (df.where(col(c).isNotNull())
                .select(col(key).alias("k"), col(c).cast("string").alias("before"))
                .orderBy("k").limit(k))
        parts.append(head.select(
            F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
            F.lit(t).alias("pii_type"), "k", "before", mask(F.col("before"), t).alias("after")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("table_name", "column_name").orderBy("k")
    return out.withColumn("rank", F.row_number().over(w)).drop("k")


def masking_summary(tables: dict[str, DataFrame], detections: DataFrame) -> DataFrame:
    """Per masked table: masked columns and its row count (all rows, changed or not)."""
    parts = detections.sparkSession.createDataFrame(
        [], "table_name string, columns_masked bigint, columns string, rows_affected bigint")
    found = types_by_table(detections)
    for name, df in tables.items():
        columns = sorted(c for c in found.get(name, {}) if c in df.columns)
        if not columns:
            continue
        row = df.agg(F.count(F.lit(1)).alias("rows_affected")).select(
            F.lit(name).alias("table_name"),
            F.lit(len(columns)).cast("bigint").alias("columns_masked"),
            F.lit(",".join(columns)).alias("columns"), "rows_affected")
        parts = parts.unionByName(row)
    return parts
