"""CSV landing files and written outputs, made from the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.functions.coerce import (
    date_layouts,
    date_readings,
    infer_types,
    null_tokens,
    parse_dates,
    profile_dtype,
    slashed_orders,
)
from dataward.operators import classify, masking, rules, validate
from dataward.session import scratch_path
from dataward.sources import csv, sinks
from queries.fixtures import MOMENT, VIEWS, WRITTEN, oracle, table, written_dates
from queries.healing import BAD_DATE
from queries.profiling import GENERATED, RULE_OUT, comparable, profiles, typed_cte
from queries.registry import query
from queries.sqlparts import NA, safe_ts

# Patients as a messy export: null tokens, a column without values, rows without values.
VIEWS["export"] = """
SELECT CASE WHEN c_custkey % 97 <> 5 THEN c_custkey END AS id,
 CASE WHEN c_custkey % 97 <> 5 THEN c_name END AS name,
 CASE WHEN c_custkey % 97 = 5 THEN NULL WHEN c_custkey % 10 = 1 THEN 'N/A' WHEN c_custkey % 10 = 2 THEN 'None' WHEN c_custkey % 10 = 3 THEN 'none' ELSE c_mktsegment END AS insurance,
 CASE WHEN c_custkey % 97 = 5 THEN 'NaN' WHEN c_custkey % 7 = 0 THEN 'null' ELSE cast(c_nationkey AS string) END AS nation,
 CASE WHEN c_custkey % 97 = 5 THEN NULL WHEN c_custkey % 9 = 0 THEN 'a "quoted", text; with | all' ELSE 'plain' END AS note,
 CASE WHEN c_custkey % 97 = 5 THEN NULL WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS active,
 cast(NULL AS string) AS nothing
FROM {customer}"""
SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}


def land(df: DataFrame, label: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.csv(path, header=True, sep=sep, encoding=encoding, escape='"')
    return path


def land_lines(df: DataFrame, label: str, header: str, line) -> str:
    """Lines written as they are, below a header in every file."""
    path = scratch_path(df.sparkSession, label)
    df.select(line.alias(header)).write.csv(path, header=True, sep="\x01", quote="")
    return path


CLEANED = f"""SELECT id, name,
 CASE WHEN insurance NOT IN ({NA}) THEN insurance END AS insurance,
 try_cast(CASE WHEN nation NOT IN ({NA}) THEN nation END AS bigint) AS nation, note,
 active = 'True' AS active FROM export WHERE id IS NOT NULL"""


@query("csv_roundtrip", oracle(CLEANED, "export"))
def csv_roundtrip(spark, sf):
    return csv.read_csv(spark, land(table(spark, sf, "export"), "csv", ";"))


@query("csv_mixed_formats", oracle(" UNION ALL ".join([f"({CLEANED})"] * 5), "export"))
def csv_mixed_formats(spark, sf):
    """One landing folder, four delimiters, one file set in a second encoding."""
    return csv.read_csv(spark, mixed(spark, sf) + "/*")


def mixed(spark, sf) -> str:
    base = scratch_path(spark, "landing")
    df = table(spark, sf, "export")
    for name, sep in SEPARATORS.items():
        df.write.csv(f"{base}/{name}", header=True, sep=sep, escape='"')
    df.write.csv(f"{base}/again", header=True, sep=";", escape='"')
    return base


@query("sniff_delimiters", """SELECT folder, delimiter FROM (VALUES ('comma', ','),
 ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|'), ('again', ';')) t(folder, delimiter)""")
def sniff_delimiters(spark, sf):
    found = csv.sniff_delimiters(spark, mixed(spark, sf) + "/*")
    return found.select(F.regexp_extract("file", "/([a-z]+)/[^/]*$", 1).alias("folder"),
                        "delimiter").distinct()


@query("detect_encodings", """SELECT folder, encoding FROM (VALUES ('utf', 'UTF-8'),
 ('latin', 'ISO-8859-1')) t(folder, encoding)""")
def detect_encodings(spark, sf):
    base = scratch_path(spark, "encodings")
    df = table(spark, sf, "customer").select("c_custkey", F.concat(
        F.lit("Zoë "), F.col("c_name")).alias("name"))
    df.write.csv(f"{base}/utf", header=True)
    df.write.csv(f"{base}/latin", header=True, encoding="ISO-8859-1")
    return csv.detect_encodings(spark, base + "/*").select(
        F.regexp_extract("file", "/([a-z]+)/[^/]*$", 1).alias("folder"), "encoding").distinct()


@query("csv_latin", """SELECT c_custkey AS id, 'Zoë, ' || c_name AS name,
 c_acctbal AS balance FROM customer""")
def csv_latin(spark, sf):
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("Zoë, "), F.col("c_name")).alias("name"),
        F.col("c_acctbal").alias("balance"))
    return csv.read_csv(spark, land(df, "latin", ";", "ISO-8859-1"))


def broken_line():
    """Trailing delimiters, short lines (two fields) and over-long ones."""
    line = F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment")
    return (F.when(F.col("c_custkey") % 10 == 4, F.concat(line, F.lit(",one,more")))
            .when(F.col("c_custkey") % 10 == 6, F.concat_ws(",", "c_custkey", "c_name"))
            .otherwise(F.concat(line, F.lit(","))))


@query("csv_malformed", """SELECT c_custkey AS id, c_name AS name,
 CASE WHEN c_custkey % 10 <> 6 THEN c_mktsegment END AS segment
FROM customer WHERE c_custkey % 10 <> 4""")
def csv_malformed(spark, sf):
    """Short lines are padded, over-long lines skipped."""
    return csv.read_csv(spark, land_lines(
        table(spark, sf, "customer"), "malformed", "id,name,segment,", broken_line()))


@query("csv_malformed_count", """
SELECT count(*) FILTER (c_custkey % 10 = 4) AS skipped_lines,
 count(*) FILTER (c_custkey % 10 <> 4) AS kept_lines FROM customer""")
def csv_malformed_count(spark, sf):
    return csv.malformed_lines(spark, land_lines(
        table(spark, sf, "customer"), "malformed", "id,name,segment,", broken_line()))


@query("csv_first_rows", "SELECT 25::bigint AS n FROM region LIMIT 1")
def csv_first_rows(spark, sf):
    """A row-limited load."""
    return csv.read_csv(spark, land(table(spark, sf, "customer"), "head"), rows=25).agg(
        F.count(F.lit(1)).alias("n"))


@query("drop_empty", oracle(
    "SELECT * EXCLUDE (nothing) FROM export WHERE id IS NOT NULL OR nation IS NOT NULL",
    "export"))
def drop_empty(spark, sf):
    return csv.drop_empty(table(spark, sf, "export"))


@query("null_tokens", oracle(f"""SELECT id, CASE WHEN insurance NOT IN ({NA}) THEN insurance END AS insurance,
 CASE WHEN nation NOT IN ({NA}) THEN nation END AS nation FROM export""", "export"))
def null_token_cells(spark, sf):
    return null_tokens(table(spark, sf, "export")).select("id", "insurance", "nation")


@query("infer_types", """SELECT * FROM (VALUES ('l_orderkey', 'int'), ('l_quantity', 'float'),
 ('l_extendedprice', 'float'), ('l_returnflag', 'object'), ('l_shipdate', 'object'),
 ('l_linenumber', 'int'), ('is_final', 'boolean')) t(column_name, dtype)""")
def inferred_types(spark, sf):
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate",
             "l_linenumber"]
    df = table(spark, sf, "lineitem").select(
        *[F.col(n).cast("string").alias(n) for n in names],
        F.when(F.col("l_linestatus") == "F", "True").otherwise("False").alias("is_final"))
    typed = infer_types(df)
    return spark.createDataFrame([(f.name, profile_dtype(f.dataType))
                                  for f in typed.schema.fields],
                                 "column_name string, dtype string")


@query("parse_dates", oracle(f"""SELECT row_key, strftime({safe_ts('order_date')}, '%Y-%m-%d') AS order_date
FROM dirty_orders""", "dirty_orders"))
def parsed_dates(spark, sf):
    return parse_dates(table(spark, sf, "dirty_orders")).select(
        "row_key", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"))


@query("csv_dates_as_text", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, event_type
FROM events""")
def csv_dates_as_text(spark, sf):
    path = scratch_path(spark, "events")
    sinks.write_csv(table(spark, sf, "events").select("event_id", "ts", "event_type"), path)
    return csv.read_csv(spark, path)


@query("quarantine_sink", oracle(f"""SELECT row_key, 'no email' AS reject_reason FROM dirty_orders WHERE email IS NULL
UNION ALL SELECT row_key, 'bad date' FROM dirty_orders WHERE {BAD_DATE}""", "dirty_orders"))
def quarantine_sink(spark, sf):
    """The first write clears what an earlier run left, later ones append."""
    df, path = table(spark, sf, "dirty_orders"), scratch_path(spark, "quarantine")
    bad_date = F.expr("""NOT coalesce(CASE WHEN order_date RLIKE '^[0-9]{4}-' THEN
        try_cast(order_date AS timestamp) BETWEEN timestamp '1900-01-01' AND
        timestamp '2026-01-01' END, false)""")
    sinks.write_quarantine(df.withColumn("reject_reason", F.lit("old run")), path, first=True)
    sinks.write_quarantine(df.where("email IS NULL").withColumn(
        "reject_reason", F.lit("no email")), path, first=True)
    sinks.write_quarantine(df.where(bad_date).withColumn(
        "reject_reason", F.lit("bad date")), path)
    return spark.read.parquet(path).select("row_key", "reject_reason")


@query("suite_store", oracle("SELECT " + ", ".join(RULE_OUT) + f" FROM ({GENERATED})",
                             "dirty_orders", ctes=typed_cte("dirty_orders")))
def suite_store(spark, sf):
    """Two versions saved, the newest loaded."""
    path, name = scratch_path(spark, "suites"), sinks.suite_name("Dirty Orders.csv")
    suite = rules.build_suite(classify.with_semantic_types(profiles(spark, sf, "dirty_orders")))
    sinks.save_suite(suite.limit(1), path, name, "2026-01-01 00:00:00", "dataward")
    sinks.save_suite(suite, path, name, "2026-01-02 00:00:00", "dataward")
    return comparable(sinks.load_suite(spark, path, name))


@query("alert_log", oracle("""SELECT '2026-01-01 00:00:00' AS stamp, 'WARNING' AS severity,
 count(*) || ' orders without email' AS message, 'dataward' AS source FROM dirty_orders WHERE email IS NULL
UNION ALL SELECT '2026-01-02 00:00:00', 'CRITICAL', count(*) || ' negative quantities', 'dataward'
FROM dirty_orders WHERE quantity < 0""", "dirty_orders"))
def alert_log(spark, sf):
    path, df = scratch_path(spark, "alerts"), table(spark, sf, "dirty_orders")
    counts = df.agg(F.count_if(F.col("email").isNull()).alias("no_email"),
                    F.count_if(F.col("quantity") < 0).alias("negative")).first()
    sinks.append_alert(spark, path, f"{counts.no_email} orders without email",
                       timestamp="2026-01-01 00:00:00")
    sinks.append_alert(spark, path, f"{counts.negative} negative quantities", "CRITICAL",
                       timestamp="2026-01-02 00:00:00")
    return spark.read.parquet(path).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "severity",
        "message", "source")


@query("csv_quoted_line_breaks", """
SELECT c_custkey AS id, 'two' || chr(10) || 'lines, "' || c_name || '"' AS name, c_mktsegment AS segment
FROM customer""")
def csv_quoted_line_breaks(spark, sf):
    """Records that go on in the next line."""
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit('two\nlines, "'), "c_name", F.lit('"')).alias("name"),
        F.col("c_mktsegment").alias("segment"))
    return csv.read_csv(spark, land(df, "breaks"))


@query("csv_mixed_headers", """
SELECT c_custkey AS id, c_name AS name, NULL AS segment FROM customer
UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def csv_mixed_headers(spark, sf):
    """Files whose columns come in another order, some with a column more."""
    base = scratch_path(spark, "headers")
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    df.select("id", "name").write.csv(f"{base}/a", header=True)
    df.select("segment", "name", "id").write.csv(f"{base}/b", header=True)
    return csv.read_csv(spark, base + "/*").select("id", "name", "segment")


@query("parse_dates_layouts", """
SELECT o_orderkey AS row_key, CASE o_orderkey % 6
  WHEN 0 THEN o_orderdate::DATE::TIMESTAMP WHEN 1 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL '10 hours 5 minutes'
  WHEN 2 THEN o_orderdate::DATE::TIMESTAMP + INTERVAL '8 hours' WHEN 3 THEN o_orderdate::DATE::TIMESTAMP
  WHEN 4 THEN o_orderdate::DATE::TIMESTAMP END AS order_date
FROM orders""")
def parse_dates_layouts(spark, sf):
    """ISO 8601, with and without zone and seconds, slashes, and days before months, which
    the column's own values settle."""
    day = "cast(o_orderdate AS date)"
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS row_key", f"""CASE o_orderkey % 6
 WHEN 0 THEN cast({day} AS string) WHEN 1 THEN concat(cast({day} AS string), 'T10:05')
 WHEN 2 THEN concat(cast({day} AS string), 'T10:00:00+02:00') WHEN 3 THEN date_format({day}, 'yyyy/MM/dd')
 WHEN 4 THEN date_format({day}, 'd/M/yyyy') ELSE 'junk' END AS order_date""")
    layouts = {r.column_name: r.layout for r in slashed_orders(df).collect()}   # one row per column
    return parse_dates(df, layouts)


@query("slashed_orders", """
SELECT 'order_date' AS column_name, count(*) AS slashed, count(*) FILTER (day(o_orderdate) > 12) AS day_first,
 0::BIGINT AS month_first, 'd/M/yyyy' AS layout FROM orders
UNION ALL SELECT 'ship_date', count(*) FILTER (day(o_orderdate) <= 12), 0, 0, NULL FROM orders""")
def slashed(spark, sf):
    """The second column has no value that tells day from month: it is not guessed."""
    day = "cast(o_orderdate AS date)"
    return slashed_orders(table(spark, sf, "orders").selectExpr(
        f"date_format({day}, 'd/M/yyyy') AS order_date",
        f"CASE WHEN day({day}) <= 12 THEN date_format({day}, 'd/M/yyyy') END AS ship_date"))


@query("parse_dates_many_layouts", f"""
SELECT o_orderkey AS row_key, {", ".join(
    f"({MOMENT if timed else 'o_orderdate::DATE::TIMESTAMP'}) AS {c}" for c, (_, timed) in WRITTEN.items())} FROM orders""")
def parse_dates_many_layouts(spark, sf):
    """Nine columns, each written in one layout throughout: not a value is lost."""
    df = written_dates(spark, sf)
    return parse_dates(df, date_layouts(df))


@query("date_readings", """
SELECT 'order_date' AS column_name, count(*) AS two_numbers, count(*) FILTER (day(o_orderdate) > 12) AS day_first,
 0::BIGINT AS month_first, 0::BIGINT AS other_dates, 'd/M/yyyy' AS layout, false AS ambiguous FROM orders
UNION ALL SELECT 'ship_date', count(*) FILTER (day(o_orderdate) <= 12), 0, 0, 0, 'M/d/yyyy', true FROM orders
UNION ALL SELECT 'due_date', count(*) FILTER (day(o_orderdate) <= 12), 0, 0, count(*) FILTER (day(o_orderdate) > 12),
 NULL, true FROM orders
UNION ALL SELECT 'paid_date', count(*), count(*) FILTER (day(o_orderdate) > 12 AND o_orderkey % 2 = 0),
 count(*) FILTER (day(o_orderdate) > 12 AND o_orderkey % 2 = 1), 0, NULL, true FROM orders
UNION ALL SELECT 'iso_date', 0, 0, 0, count(*), NULL, false FROM orders""")
def readings(spark, sf):
    """Settled, ambiguous alone and beside other dates, contradictory, and without a choice."""
    day = "cast(o_orderdate AS date)"
    return date_readings(table(spark, sf, "orders").selectExpr(
        f"date_format({day}, 'd/M/yyyy') AS order_date",
        f"CASE WHEN day({day}) <= 12 THEN date_format({day}, 'd.M.yyyy') ELSE 'open' END AS ship_date",
        f"CASE WHEN day({day}) <= 12 THEN date_format({day}, 'd/M/yyyy') ELSE date_format({day}, 'd MMM yyyy') END AS due_date",
        f"date_format({day}, CASE WHEN o_orderkey % 2 = 0 THEN 'd/M/yyyy' ELSE 'M/d/yyyy' END) AS paid_date",
        f"cast({day} AS string) AS iso_date"))


@query("clean_sink", oracle("""
SELECT row_key, order_id, status, 'parquet' AS fmt FROM dirty_orders
UNION ALL SELECT row_key, order_id, CASE WHEN status <> '' THEN status END, 'csv' FROM dirty_orders""", "dirty_orders"))
def clean_sink(spark, sf):
    """The healed table in two formats; a second write replaces the first."""
    df = table(spark, sf, "dirty_orders").select("row_key", "order_id", "status")
    out = []
    for fmt in ("parquet", "csv"):
        path = scratch_path(spark, f"clean-{fmt}")
        sinks.write_clean(df.limit(5), path, fmt)
        sinks.write_clean(df, path, fmt)
        back = spark.read.parquet(path) if fmt == "parquet" else csv.read_csv(spark, path)
        out.append(back.withColumn("fmt", F.lit(fmt)))
    return out[0].unionByName(out[1])


def table_name(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex[:12]}"


@query("saved_tables", oracle("""
SELECT 'clean' AS part, row_key FROM dirty_orders WHERE email IS NOT NULL
UNION ALL SELECT 'quarantine', row_key FROM dirty_orders WHERE email IS NULL""", "dirty_orders"))
def saved_tables(spark, sf):
    """Results of a run as tables named after the file; saving again replaces them."""
    df, name = table(spark, sf, "dirty_orders").select("row_key", "email"), table_name("dirty orders")
    sinks.save_results(df.limit(3), df.limit(1), f"{name}.csv")
    names = sinks.save_results(df.where("email IS NOT NULL"), df.where("email IS NULL"), f"{name}.csv")
    return reduce(lambda a, b: a.unionByName(b), [
        spark.table(n).select(F.lit(n.rsplit("_", 1)[-1]).alias("part"), "row_key") for n in names])


@query("saved_masked", oracle("""
SELECT row_key, left(email, 1) || '***' || substr(email, strpos(email, '@')) AS email FROM customer_pii""",
    "customer_pii"))
def saved_masked(spark, sf):
    name = table_name("people")
    tables = {name: table(spark, sf, "customer_pii").select("row_key", "email")}
    found = spark.createDataFrame([(name, "email", "EMAIL")], "table_name string, column_name string, pii_type string")
    return spark.table(sinks.save_masked(masking.mask_tables(tables, found))[0])


@query("missing_suite", oracle("""
SELECT 0::BIGINT AS evaluated_expectations, false AS success, 'Suite ''none'' not found' AS error,
 count(*) AS stored_rules FROM (SELECT DISTINCT 1 FROM dirty_orders)""", "dirty_orders"))
def missing_suite(spark, sf):
    """Asking the store for a suite it does not hold."""
    path = scratch_path(spark, "suites")
    suite = rules.build_suite(classify.with_semantic_types(profiles(spark, sf, "dirty_orders")))
    sinks.save_suite(suite.limit(1), path, "some", "2026-01-01 00:00:00", "dataward")
    assert sinks.load_suite(spark, path, "none").isEmpty()
    stored = sinks.load_suite(spark, path, "some").agg(F.count(F.lit(1)).alias("n")).scalar()
    return validate.missing_suite(spark, "none").select(
        "evaluated_expectations", "success", "error", stored.alias("stored_rules"))
