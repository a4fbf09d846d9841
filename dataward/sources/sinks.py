"""Writers: clean and quarantine outputs, tables, suites, alerts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.functions.coerce import TEMPORAL, col
from dataward.operators.rules import RULE_COLUMNS


def base_name(file_name: str) -> str:
    """File stem in lower case with blanks and hyphens as underscores."""
    stem = file_name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return stem.lower().replace(" ", "_").replace("-", "_")


def suite_name(file_name: str) -> str:
    stem = file_name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return re.sub("[^a-z0-9_]", "_", stem.lower()) + "_quality_suite"


def dates_as_text(df: DataFrame) -> DataFrame:
    """Points in time as yyyy-MM-dd; the time of day is lost, as in every CSV output."""
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]
    return df.withColumns({c: F.date_format(col(c), "yyyy-MM-dd") for c in dates})


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    dates_as_text(df).write.mode(mode).csv(path, header=True, escape='"')


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The healed table, on success and, best effort, on an alert."""
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_quarantine(df: DataFrame, path: str, first: bool = False) -> None:
    """Rejected rows with their reason. The first write of a run clears the old ones."""
    df.write.mode("overwrite" if first else "append").parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "replace") -> None:
    df.write.mode({"replace": "overwrite"}.get(mode, mode)).saveAsTable(name)


def save_results(clean: DataFrame, quarantine: DataFrame | None, file_name: str) -> list[str]:
    """<base>_clean and <base>_quarantine."""
    base = base_name(file_name)
    save_table(clean, f"{base}_clean")
    if quarantine is None:
        return [f"{base}_clean"]
    save_table(quarantine, f"{base}_quarantine")
    return [f"{base}_clean", f"{base}_quarantine"]


def save_masked(tables: dict[str, DataFrame]) -> list[str]:
    """<table>_masked for each masked table."""
    for name, df in tables.items():
        save_table(df, f"{name}_masked")
    return [f"{name}_masked" for name in tables]


def save_suite(rules: DataFrame, path: str, suite: str, created_at, created_by: str) -> None:
    """Append a rule suite with its metadata, one partition per suite."""
    (rules.select(RULE_COLUMNS)
     .withColumns({"created_at": F.lit(created_at).cast("timestamp"),
                   "created_by": F.lit(created_by), "suite": F.lit(suite)})
     .write.mode("append").partitionBy("suite").parquet(path))


def load_suite(spark: SparkSession, path: str, suite: str) -> DataFrame:
    """The newest version of a saved suite; no rows when there is none."""
    rules = spark.read.parquet(path).where(F.col("suite") == suite)
    latest = rules.agg(F.max("created_at").alias("created_at"))
    return rules.join(F.broadcast(latest), "created_at").select(RULE_COLUMNS)


def append_alert(spark: SparkSession, path: str, message: str, severity: str = "WARNING",
                 source: str = "dataward", timestamp=None) -> None:
    row = spark.createDataFrame([(severity, message, source)],
                                "severity string, message string, source string")
    stamp = F.current_timestamp() if timestamp is None else F.lit(timestamp).cast("timestamp")
    row.select(stamp.alias("timestamp"), "severity", "message", "source").write.mode(
        "append").parquet(path)
