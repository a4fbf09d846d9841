"""Lineage edges, catalog versions and table reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from dataward.operators import catalog, lineage, masking, pii, reports
from dataward.plans.governance_run import governance_run, persist_run
from dataward.session import scratch_path
from queries.fixtures import oracle, table
from queries.privacy import DETECTED_TYPES
from queries.registry import query

EDGES = """SELECT src_table, src_col, tgt_table, tgt_col,
 arg_min(transform, edge_order) AS transform FROM edge_log GROUP BY ALL"""
TAGS = """SELECT table_name, column_name, arg_max(pii_type, seq) AS pii_type,
 arg_max(confidence, seq) AS confidence, arg_max(detection_method, seq) AS detection_method
FROM tag_log GROUP BY ALL"""
EDGE = "src_table, src_col, tgt_table, tgt_col"


def edges(spark, sf):
    return lineage.deduplicate_edges(table(spark, sf, "edge_log"))


def tags(spark, sf):
    return catalog.latest(table(spark, sf, "tag_log"), ["table_name", "column_name"], "seq")


@query("lineage_edges", oracle(EDGES, "edge_log"))
def lineage_edges(spark, sf):
    return edges(spark, sf).drop("edge_order")


@query("lineage_sources_targets", oracle("""
SELECT 'target' AS role, tgt_table AS table_name FROM edge_log GROUP BY tgt_table
UNION ALL SELECT 'source', src_table FROM (SELECT src_table FROM edge_log EXCEPT
 SELECT tgt_table FROM edge_log)""", "edge_log"))
def lineage_sources_targets(spark, sf):
    return lineage.sources_and_targets(table(spark, sf, "edge_log"))


@query("lineage_column_map", oracle("""
SELECT tgt_col, arg_max(src_table, edge_order) AS source_table,
 arg_max(src_col, edge_order) AS source_col, arg_max(transform, edge_order) AS transform
FROM edge_log GROUP BY tgt_col""", "edge_log"))
def lineage_column_map(spark, sf):
    return lineage.column_map(table(spark, sf, "edge_log"))


@query("lineage_flows", oracle("""
SELECT src_table, tgt_table, count(*) AS edges,
 array_to_string(list_sort(list(DISTINCT transform)), ',') AS transforms
FROM edges GROUP BY ALL""", "edge_log", ctes={"edges": EDGES}))
def lineage_flows(spark, sf):
    return lineage.flows(edges(spark, sf))


@query("lineage_pii", oracle(f"""
SELECT {EDGE}, transform, s.pii_type AS src_pii, t.pii_type AS tgt_pii,
 coalesce(s.pii_type, t.pii_type, '—') AS pii
FROM edges LEFT JOIN tags s ON s.table_name = src_table AND s.column_name = src_col
LEFT JOIN tags t ON t.table_name = tgt_table AND t.column_name = tgt_col""",
    "edge_log", "tag_log", ctes={"edges": EDGES, "tags": TAGS}))
def lineage_pii(spark, sf):
    return lineage.tag_edges(edges(spark, sf), tags(spark, sf)).drop("edge_order")


@query("lineage_summary", oracle("""
SELECT (SELECT count(*) FROM (SELECT src_table FROM edges EXCEPT SELECT tgt_table FROM edges)) AS sources,
 (SELECT count(DISTINCT tgt_table) FROM edges) AS targets,
 (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM tags) AS pii_columns""",
    "edge_log", "tag_log", ctes={"edges": EDGES, "tags": TAGS}))
def lineage_summary(spark, sf):
    return lineage.summary(edges(spark, sf), tags(spark, sf))


# ---- catalog: the logs arrive in two loads, told apart by their order column --------

FIRST, SECOND = "2026-01-01 00:00:00", "2026-01-02 00:00:00"


def loads(df, order):
    """First and second load of a log."""
    return df.where(F.col(order) % 2 == 0), df.where(F.col(order) % 2 == 1)


def day(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


def load_sql(source: str, order: str, n: int) -> str:
    return f"(SELECT * FROM {source} WHERE {order} % 2 = {n})"


@query("catalog_upsert_edges", oracle(f"""
SELECT {EDGE}, arg_min(transform, edge_order) AS transform, '2026-01-02' AS created_at
FROM {load_sql('edge_log', 'edge_order', 1)} GROUP BY {EDGE}
UNION ALL
SELECT {EDGE}, arg_min(transform, edge_order), '2026-01-01'
FROM {load_sql('edge_log', 'edge_order', 0)} a
WHERE NOT EXISTS (SELECT 1 FROM {load_sql('edge_log', 'edge_order', 1)} b
 WHERE a.src_table = b.src_table AND a.src_col = b.src_col
  AND a.tgt_table = b.tgt_table AND a.tgt_col = b.tgt_col) GROUP BY {EDGE}""", "edge_log"))
def catalog_upsert_edges(spark, sf):
    first, second = loads(table(spark, sf, "edge_log"), "edge_order")
    return day(catalog.upsert_edges(catalog.upsert_edges(None, first, FIRST), second, SECOND))


KEPT_TAGS = f"""
SELECT table_name, column_name, arg_max(pii_type, seq) AS pii_type, arg_max(confidence, seq) AS confidence,
 arg_max(detection_method, seq) AS detection_method, '2026-01-02' AS created_at
FROM {load_sql('tag_log', 'seq', 1)} GROUP BY ALL
UNION ALL
SELECT table_name, column_name, arg_max(pii_type, seq), arg_max(confidence, seq),
 arg_max(detection_method, seq), '2026-01-01' FROM {load_sql('tag_log', 'seq', 0)}
WHERE (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM {load_sql('tag_log', 'seq', 1)})
GROUP BY table_name, column_name"""


def stored_tags(spark, sf):
    stored = None
    for load, stamp in zip(loads(table(spark, sf, "tag_log"), "seq"), (FIRST, SECOND),
                           strict=True):
        found = catalog.latest(load, ["table_name", "column_name"], "seq").withColumn(
            "sample_values", F.array("pii_type"))
        stored = catalog.upsert_tags(stored, found, stamp)
    return stored


@query("catalog_upsert_tags", oracle(
    f"SELECT *, '[\"' || pii_type || '\"]' AS sample_values FROM ({KEPT_TAGS})", "tag_log"))
def catalog_upsert_tags(spark, sf):
    return day(stored_tags(spark, sf))


@query("catalog_upsert_incremental", oracle(f"""
SELECT table_name, column_name, pii_type, CASE WHEN table_name = 'customer_pii' THEN 1.0 ELSE confidence END AS confidence
FROM ({TAGS}) UNION ALL SELECT 'new_table', 'email', 'EMAIL', 0.5""", "tag_log"))
def catalog_upsert_incremental(spark, sf):
    """A second batch changes one table's tags and adds one: only its buckets are written."""
    path, keys = scratch_path(spark, "tags"), ["table_name", "column_name"]
    first = tags(spark, sf).select(*keys, "pii_type", "confidence")
    catalog.upsert_stored(path, first, keys)
    changes = first.where("table_name = 'customer_pii'").withColumn("confidence", F.lit(1.0)).unionByName(
        spark.createDataFrame([("new_table", "email", "EMAIL", 0.5)], first.schema))
    catalog.upsert_stored(path, changes, keys)
    return catalog.read_stored(spark, path)


@query("catalog_columns", oracle(f"""
SELECT table_name, column_name, CASE WHEN table_name = 'customer_pii' AND column_name IN ('email', 'ssn', 'full_name') THEN 'object' END AS data_type,
 1 AS is_pii, pii_type, confidence AS pii_confidence,
 CASE WHEN confidence >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS sensitivity, 0 AS masked
FROM ({KEPT_TAGS})""", "tag_log"))
def catalog_columns(spark, sf):
    types = spark.createDataFrame(
        [("customer_pii", c, "object") for c in DETECTED_TYPES],
        "dataset string, column_name string, dtype string")
    return catalog.upsert_columns(None, stored_tags(spark, sf), types)


@query("catalog_tables", oracle("""
SELECT table_name, 'SELECT 1' AS source_sql, '2026-01-01' AS created_at,
 NULL::bigint AS row_count, NULL::bigint AS column_count,
 CASE WHEN table_name IN (SELECT table_name FROM tag_log) THEN 1 ELSE 0 END AS has_pii,
 CASE WHEN table_name IN (SELECT table_name FROM tag_log) THEN 'CRITICAL' ELSE 'LOW' END AS risk_level
FROM (SELECT DISTINCT tgt_table AS table_name FROM edge_log)""", "edge_log", "tag_log"))
def catalog_tables(spark, sf):
    """Targets stored, flagged where tagged, raised to the risk of their advice."""
    log, found = table(spark, sf, "edge_log"), tags(spark, sf)
    stored = catalog.upsert_target_tables(None, log, "SELECT 1", FIRST)
    report = spark.createDataFrame([("CRITICAL",)], "risk_level string")
    return day(catalog.apply_risk(catalog.flag_tables(stored, found), report, found))


@query("catalog_replace_resets", oracle("""
SELECT tgt_table AS table_name, CASE WHEN bool_or(edge_order % 2 = 1) THEN 0
  WHEN tgt_table IN (SELECT table_name FROM tag_log) THEN 1 ELSE 0 END AS has_pii,
 CASE WHEN bool_or(edge_order % 2 = 1) THEN '2026-01-02' ELSE '2026-01-01' END AS created_at
FROM edge_log GROUP BY tgt_table""", "edge_log", "tag_log"))
def catalog_replace_resets(spark, sf):
    """A target loaded again loses its flag until it is tagged again."""
    first, second = loads(table(spark, sf, "edge_log"), "edge_order")
    stored = catalog.flag_tables(
        catalog.upsert_target_tables(None, first, "first", FIRST), tags(spark, sf))
    return day(catalog.upsert_target_tables(stored, second, "second", SECOND)).select(
        "table_name", "has_pii", "created_at")


@query("governance_run", oracle("""
SELECT 'lineage_edges' AS catalog_table, (SELECT count(*) FROM (SELECT DISTINCT src_table, src_col, tgt_table, tgt_col FROM edge_log)) AS row_count
UNION ALL SELECT 'catalog_tables', (SELECT count(DISTINCT tgt_table) FROM edge_log)
UNION ALL SELECT 'pii_tags', 15 UNION ALL SELECT 'catalog_columns', 15
UNION ALL SELECT 'governance_reports', 1""", "edge_log"))
def governance_run_counts(spark, sf):
    """Edges to detections to risk to masking, stored in the five catalog tables."""
    tables = {"customer_pii": table(spark, sf, "customer_pii"),
              "part": table(spark, sf, "part")}
    run = governance_run(tables, table(spark, sf, "edge_log"))
    stored = persist_run(run, {}, FIRST, "SELECT 1")
    return reports.table_counts(stored).withColumnRenamed("table_name", "catalog_table")


@query("catalog_report", oracle("""
SELECT 'CRITICAL' AS risk_level, 1.0::double AS risk_score, 15::bigint AS pii_count,
 (SELECT count(DISTINCT t) FROM (SELECT src_table AS t FROM edge_log
  UNION ALL SELECT tgt_table FROM edge_log)) AS tables_analyzed, '2026-01-01' AS created_at,
 (15 + 5 + 5 + 1)::bigint AS advice""", "edge_log"))
def catalog_report(spark, sf):
    tables = {"customer_pii": table(spark, sf, "customer_pii")}
    run = governance_run(tables, table(spark, sf, "edge_log"))
    stored = persist_run(run, {}, FIRST)["governance_reports"]
    return day(stored).select(
        "risk_level", "risk_score", "pii_count", "tables_analyzed", "created_at",
        F.json_array_length("recommendations").cast("bigint").alias("advice"))


# ---- tables and SQL -----------------------------------------------------------------

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def table_counts(spark, sf):
    return reports.table_counts({t: table(spark, sf, t) for t in TABLES})


CONSOLE = """SELECT status, count(*) AS n, round(sum(order_amount), 2) AS amount
FROM console_orders GROUP BY status"""


@query("sql_console", oracle(CONSOLE.replace("console_orders", "dirty_orders"),
                             "dirty_orders"))
def sql_console(spark, sf):
    table(spark, sf, "dirty_orders").createOrReplaceTempView("console_orders")
    return reports.console(spark, CONSOLE + ";")


@query("sql_query_result", oracle("""
SELECT 'row_key,status' AS columns, count(*) AS row_count, least(count(*), 100) AS shown
FROM dirty_orders WHERE quantity < 0""", "dirty_orders"))
def sql_query_result(spark, sf):
    """Full row count, column names and the first hundred rows of a query."""
    table(spark, sf, "dirty_orders").createOrReplaceTempView("console_orders")
    found = reports.run_sql(spark, "SELECT row_key, status FROM console_orders WHERE quantity < 0")
    return spark.createDataFrame(
        [(",".join(found["columns"]), found["row_count"], len(found["rows"]))],
        "columns string, row_count bigint, shown bigint")


@query("governance_run_no_tables", oracle("""
SELECT 'LOW' AS risk_level, 0.0::DOUBLE AS risk_score, 0::BIGINT AS pii_count,
 (SELECT count(DISTINCT t) FROM (SELECT src_table AS t FROM edge_log
  UNION ALL SELECT tgt_table FROM edge_log)) AS tables_analyzed, 0::BIGINT AS masked""", "edge_log"))
def governance_run_no_tables(spark, sf):
    """Edges whose tables cannot be read: nothing found, minimal risk."""
    run = governance_run({}, table(spark, sf, "edge_log"))
    return run.report.select("risk_level", "risk_score", "pii_count", "tables_analyzed",
                             F.lit(len(run.masked)).cast("bigint").alias("masked"))


@query("governance_run_no_scalars", oracle("""
SELECT DISTINCT 'LOW' AS risk_level, 0::BIGINT AS pii_count, 0::BIGINT AS masked_tables FROM edge_log""", "edge_log"))
def governance_run_no_scalars(spark, sf):
    """A table without a single scalar column."""
    arrays = {"customer_pii": table(spark, sf, "embeddings").select(F.col("embedding").alias("vector"))}
    run = governance_run(arrays, table(spark, sf, "edge_log"))
    summary = masking.masking_summary(arrays, run.detections)
    return run.report.select("risk_level", "pii_count", summary.agg(
        F.count(F.lit(1)).alias("n")).scalar().alias("masked_tables"))


@query("catalog_schemas", oracle("""
SELECT 'catalog_tables' AS catalog_table, 7::BIGINT AS n_columns, count(DISTINCT tgt_table) AS n_rows FROM edge_log
UNION ALL SELECT 'lineage_edges', 6, count(*) FROM (SELECT DISTINCT src_table, src_col, tgt_table, tgt_col FROM edge_log)
UNION ALL SELECT 'pii_tags', 7, 0 UNION ALL SELECT 'catalog_columns', 8, 0""", "edge_log"))
def catalog_schemas(spark, sf):
    """Empty catalog tables have the schemas of the filled ones, so first loads go on top of them."""
    log = table(spark, sf, "edge_log")
    stored = {n: catalog.empty_table(spark, n) for n in ("catalog_tables", "lineage_edges", "pii_tags", "catalog_columns")}
    stored["lineage_edges"] = catalog.upsert_edges(stored["lineage_edges"], log, FIRST)
    stored["catalog_tables"] = catalog.upsert_target_tables(stored["catalog_tables"], log, "sql", FIRST)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(n).alias("catalog_table"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_rows")
        for n, df in stored.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("detect_from_catalog", oracle("""
SELECT DISTINCT 'customer_pii' AS table_name, 15::BIGINT AS detected FROM edge_log""", "edge_log"))
def detect_from_catalog(spark, sf):
    """The tables the edges name, read from the session's catalog; unknown ones are skipped."""
    table(spark, sf, "customer_pii").createOrReplaceTempView("customer_pii")
    found = pii.detect_pii(pii.lineage_tables(spark, table(spark, sf, "edge_log")))
    return found.groupBy("table_name").agg(F.count(F.lit(1)).alias("detected"))
