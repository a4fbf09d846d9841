"""Reports over tables and runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.operators.actions import DATASET, column_key
from dataward.operators.risk import percent


def run_sql(spark: SparkSession, query: str, rows: int = 100) -> dict:
    """Row count, column names and the first rows of a query."""
    result = spark.sql(query)
    return {"success": True, "row_count": result.count(), "columns": result.columns,
            "rows": [r.asDict() for r in result.limit(rows).collect()]}


def console(spark: SparkSession, text: str) -> DataFrame:
    """A SELECT, or PRAGMA table_info(t) answered by DESCRIBE."""
    statement = text.strip().rstrip(";")
    if statement.upper().startswith("PRAGMA"):
        table = statement[statement.index("(") + 1:statement.rindex(")")].strip("'\"` ")
        return spark.sql(f"DESCRIBE TABLE `{table}`")
    if not statement.upper().startswith(("SELECT", "WITH")):
        raise ValueError("only SELECT and PRAGMA statements return rows")
    return spark.sql(statement)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count); counts of parquet tables come from file footers."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()])


def list_tables(spark: SparkSession) -> DataFrame:
    return table_counts({t.name: spark.table(t.name) for t in spark.catalog.listTables()})


def run_metrics(clean: DataFrame, quarantined: DataFrame | None, statistics: DataFrame,
                cycles: int, status: str) -> DataFrame:
    """One row: clean rows, set-aside rows, pass rate, cycles and status of a run."""
    gone = F.lit(0).cast("bigint") if quarantined is None else quarantined.agg(
        F.count(F.lit(1))).scalar()
    return clean.agg(F.count(F.lit(1)).alias("clean_rows")).select(
        "*", gone.alias("quarantined_rows"),
        statistics.select(F.floor("success_percent")).scalar().alias("pass_rate"),
        F.lit(cycles).cast("bigint").alias("cycles"), F.lit(status).alias("status"))


def healing_ledger(history: DataFrame) -> DataFrame:
    """Applied repairs, one line each."""
    return history.select(
        F.col("column_name").alias("column"), F.col("action_type").alias("action"),
        F.coalesce("operation_or_condition", F.lit("—")).alias("detail"),
        "rows_affected", "remaining_rows",
        F.coalesce(percent(F.col("confidence")), F.lit("N/A")).alias("confidence"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"))


def healing_history(history: DataFrame) -> DataFrame:
    """Repairs of all cycles; shown for runs of more than one cycle."""
    return history.select(
        "iteration", F.col("column_name").alias("column"),
        F.col("action_type").alias("action"),
        F.coalesce("operation_or_condition", F.lit("—")).alias("detail"),
        "rows_affected", "success",
        F.coalesce(percent(F.col("confidence")), F.lit("—")).alias("confidence"))


def type_report(typed: DataFrame, confidence: DataFrame) -> DataFrame:
    """Semantic type and best repair confidence per column, of one table or, with a ``dataset``
    in both inputs, of many."""
    key = column_key(typed, confidence)
    return typed.select(*key, "ordinal", "semantic_type").join(
        confidence.select(*key, "confidence"), key, "left").select(
        *key[:-1], "ordinal", "column_name", "semantic_type",
        F.when(F.col("confidence") > 0, percent(F.col("confidence"))).otherwise("—")
        .alias("repair_confidence"))


def alert_line(semantic: Column, confidence: Column) -> Column:
    return F.concat(
        F.lit("  - "), F.col("expectation_type"), F.lit(" on '"), F.col("column_name"),
        F.lit("' (semantic type: "), F.coalesce(semantic, F.lit("unknown")), F.lit(", "),
        F.coalesce(F.concat(F.lit("repair confidence "), percent(confidence)),
                   F.lit("not attempted")),
        F.lit("): "), F.col("failing_count").cast("string"), F.lit(" rows"))


def alert_message(results: DataFrame, typed: DataFrame, confidence: DataFrame,
                  cycles: int) -> DataFrame:
    """The alert text for a run that could not heal itself; one line per failed rule. Results
    with a ``dataset`` give one row for each."""
    types, sure = column_key(results, typed), column_key(results, confidence)
    own = [c for c in results.columns if c == DATASET]
    lines = (results.where(~F.col("success"))
             .join(typed.select(*types, "semantic_type"), types, "left")
             .join(confidence.select(*sure, "confidence"), sure, "left")
             .select(*own, "rule_order", alert_line(F.col("semantic_type"), F.col("confidence"))
                     .alias("line")))
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rule_order", "line"))),
        lambda s: s["line"]), "\n")
    count = F.count(F.lit(1))
    return (lines.groupBy(*own) if own else lines).agg(
        F.lit("CRITICAL").alias("severity"),
        F.concat(F.lit(f"DATA QUALITY ALERT: pipeline could not self-heal after {cycles} "
                       "iteration(s).\n\nUnresolved failures ("), count.cast("string"),
                 F.lit("):\n"), joined, F.lit("\n\nMANUAL INTERVENTION REQUIRED."))
        .alias("message"))
