"""Dirty views over the given tables, in SQL that Spark and the check engine both run.

{name} stands for a base table. row_key is the order column for every "first"."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2026-01-01"

VIEWS = {
    "dirty_orders": """
SELECT o_orderkey AS row_key,
 CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 1 ELSE o_orderkey END AS order_id,
 o_custkey AS customer_id,
 CASE o_custkey % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Raj Patel' WHEN 2 THEN 'Li' ELSE 'Mary J Smith' END AS customer_name,
 CASE WHEN o_orderkey % 25 = 3 THEN NULL WHEN o_orderkey % 40 = 1 THEN 'notanemail' WHEN o_orderkey % 200 = 2 THEN 'user@@double.com' ELSE concat('user', cast(o_custkey AS string), '@example.com') END AS email,
 CASE o_orderkey % 5 WHEN 0 THEN 'Laptop' WHEN 1 THEN 'Phone' WHEN 2 THEN 'Tablet' WHEN 3 THEN 'Monitor' ELSE 'Keyboard' END AS product,
 CASE WHEN o_orderkey % 60 = 11 THEN -1 - o_orderkey % 10 ELSE 1 + o_orderkey % 10 END AS quantity,
 CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice ELSE o_totalprice END AS order_amount,
 CASE WHEN o_orderkey % 33 = 0 THEN '2099-01-01' WHEN o_orderkey % 47 = 0 THEN 'not-a-date' ELSE cast(cast(o_orderdate AS date) AS string) END AS order_date,
 CASE WHEN o_orderkey % 50 = 0 THEN 'ERROR' WHEN o_orderkey % 50 = 25 THEN '' WHEN o_orderkey % 4 = 0 THEN 'pending' WHEN o_orderkey % 4 = 1 THEN 'processing' WHEN o_orderkey % 4 = 2 THEN 'shipped' ELSE 'delivered' END AS status
FROM {orders}""",
    "dirty_patients": """
SELECT c_custkey AS row_key,
 concat('PAT-', lpad(cast(CASE WHEN c_custkey % 50 = 9 THEN c_custkey - 1 ELSE c_custkey END AS string), 7, '0')) AS patient_id,
 CASE WHEN c_custkey % 25 = 4 THEN 'missing-at-sign.com' WHEN c_custkey % 50 = 11 THEN NULL ELSE concat('p', cast(c_custkey AS string), '@health.net') END AS email,
 CASE WHEN c_custkey % 50 = 13 THEN 'not-a-phone' ELSE concat('+1-555-', lpad(cast(c_custkey % 1000 AS string), 3, '0'), '-', lpad(cast(c_custkey % 10000 AS string), 4, '0')) END AS phone,
 CASE WHEN c_custkey % 100 = 17 THEN '-5' WHEN c_custkey % 100 = 18 THEN '350' WHEN c_custkey % 100 = 19 THEN 'unknown' ELSE cast(1 + c_custkey % 95 AS string) END AS age,
 CASE WHEN c_custkey % 20 = 1 THEN 'TBD' WHEN c_custkey % 50 = 2 THEN '2099-01-01' WHEN c_custkey % 50 = 3 THEN '1899-12-31' ELSE concat('2023-01-', lpad(cast(1 + c_custkey % 28 AS string), 2, '0')) END AS admission_date,
 CASE WHEN c_custkey % 14 = 0 THEN 'Cardiolgy' WHEN c_custkey % 4 = 0 THEN 'Cardiology' WHEN c_custkey % 4 = 1 THEN 'Neurology' WHEN c_custkey % 4 = 2 THEN 'Oncology' ELSE 'Radiology' END AS department,
 CASE WHEN c_custkey % 25 = 6 THEN '--' WHEN c_custkey % 25 = 7 THEN 'MISSING' WHEN c_custkey % 25 = 8 THEN '-120.5' ELSE cast(500 + c_custkey % 1000 AS string) END AS total_cost,
 CASE WHEN c_custkey % 5 < 3 THEN NULL ELSE 'Discharged' END AS discharge_status
FROM {customer}""",
    "customer_pii": """
SELECT c_custkey AS row_key,
 concat('user', cast(c_custkey AS string), '@example.com') AS email,
 cast(9000000000 + c_custkey AS string) AS phone_number,
 CASE c_custkey % 3 WHEN 0 THEN 'John Doe' WHEN 1 THEN 'Li' ELSE 'A B Carter' END AS full_name,
 concat(cast(c_custkey AS string), ' Main St') AS home_address,
 concat('1234 5678 ', lpad(cast(c_custkey % 10000 AS string), 4, '0')) AS aadhaar_number,
 concat('ABCDE', lpad(cast(c_custkey % 10000 AS string), 4, '0'), 'F') AS pan_number,
 concat('A', lpad(cast(c_custkey AS string), 7, '0')) AS passport_no,
 concat('123-45-', lpad(cast(c_custkey % 10000 AS string), 4, '0')) AS ssn,
 concat('411111111111', lpad(cast(c_custkey % 10000 AS string), 4, '0')) AS card_number,
 concat('1990-05-', lpad(cast(1 + c_custkey % 28 AS string), 2, '0')) AS dob,
 concat('192.168.1.', cast(c_custkey % 256 AS string)) AS client_ip,
 concat('10.0.0.', cast(c_custkey % 256 AS string)) AS ip_address,
 'widget' AS product_name,
 CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN '  ' ELSE concat('c', cast(c_custkey AS string), '@alt.org') END AS handle,
 concat('2023-01-', lpad(cast(1 + c_custkey % 28 AS string), 2, '0')) AS signup_day
FROM {customer}""",
    # Column edges as logged by a warehouse's jobs: one row per event, keys repeat, one
    # target takes a third of all rows, some tables are both source and target.
    "edge_log": """
SELECT event_id AS edge_order, user_id % 100 AS run_id,
 CASE WHEN event_id % 4 = 0 THEN 'customer_pii' ELSE concat('raw_', cast(user_id AS string)) END AS src_table,
 CASE event_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'ssn' WHEN 2 THEN 'amount' WHEN 3 THEN 'full_name' ELSE 'status' END AS src_col,
 CASE event_id % 3 WHEN 0 THEN concat('mart_', cast(user_id % 20 AS string)) WHEN 1 THEN 'premium_customers' ELSE concat('raw_', cast(user_id % 7 AS string)) END AS tgt_table,
 concat('c_', cast(event_id % 11 AS string)) AS tgt_col,
 CASE event_type WHEN 'error' THEN 'sum' WHEN 'click' THEN 'upper' ELSE 'direct' END AS transform
FROM {events}""",
    # Detections as logged by repeated scans: the same column is tagged again and again.
    "tag_log": """
SELECT o_orderkey AS seq, o_custkey % 100 AS run_id,
 CASE WHEN o_orderkey % 3 = 0 THEN 'customer_pii' ELSE concat('raw_', cast(o_custkey AS string)) END AS table_name,
 CASE o_orderkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'ssn' WHEN 2 THEN 'amount' WHEN 3 THEN 'full_name' ELSE 'pan' END AS column_name,
 CASE o_orderkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'SSN' WHEN 2 THEN 'OTHER' WHEN 3 THEN 'NAME' ELSE 'PAN' END AS pii_type,
 cast(35 + o_orderkey % 60 AS double) / 100 AS confidence,
 CASE o_orderkey % 2 WHEN 0 THEN 'keyword' ELSE 'keyword+regex' END AS detection_method,
 o_orderdate AS tagged_at
FROM {orders}""",
    # Column names of a large warehouse, one per part.
    "column_names": """
SELECT concat('t_', cast(p_partkey % 97 AS string)) AS table_name, p_partkey AS ordinal,
 concat(
  CASE p_partkey % 31 WHEN 0 THEN 'email' WHEN 1 THEN 'user_email' WHEN 2 THEN 'mobile'
   WHEN 3 THEN 'contact_number' WHEN 4 THEN 'full_name' WHEN 5 THEN 'product_name'
   WHEN 6 THEN 'home_address' WHEN 7 THEN 'city' WHEN 8 THEN 'zip' WHEN 9 THEN 'aadhaar'
   WHEN 10 THEN 'uid' WHEN 11 THEN 'pan' WHEN 12 THEN 'company' WHEN 13 THEN 'passport_no'
   WHEN 14 THEN 'dob' WHEN 15 THEN 'birthdate' WHEN 16 THEN 'ssn' WHEN 17 THEN 'ip_address'
   WHEN 18 THEN 'client_ip' WHEN 19 THEN 'card_num' WHEN 20 THEN 'amount'
   WHEN 21 THEN 'fluid_level' WHEN 22 THEN 'expansion' WHEN 23 THEN 'hotel'
   WHEN 24 THEN 'filename' WHEN 25 THEN 'status' WHEN 26 THEN 'capacity'
   WHEN 27 THEN 'e_mail' WHEN 28 THEN 'file_name' WHEN 29 THEN 'cell' ELSE 'total' END,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat('_', replace(p_name, ' ', '_')) END
 ) AS column_name
FROM {part}""",
}


def _base_tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or one of the views above."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _base_tables(sql)})


def oracle(sql: str, *views: str, ctes: dict[str, str] | None = None) -> str:
    """The SQL with the views, and any further named parts, in front of it."""
    parts = {v: VIEWS[v].format(**{t: t for t in _base_tables(VIEWS[v])}) for v in views}
    parts |= ctes or {}
    if not parts:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n" + sql


# Columns that hold one layout throughout, all of the same days: Spark's pattern, and the part
# of the day that it keeps.
WRITTEN = {"named_date": ("d MMM yyyy", False), "long_date": ("MMMM d, yyyy", False), "compact_date": ("yyyyMMdd", False),
           "dotted_date": ("yyyy.MM.dd", False), "day_date": ("dd.MM.yyyy", False), "month_date": ("M/d/yyyy", False),
           "short_date": ("dd-MMM-yy", False), "stamp_time": ("yyyyMMdd HH:mm:ss", True),
           "half_time": ("MM/dd/yyyy hh:mm a", True)}
MOMENT = "o_orderdate::DATE::TIMESTAMP + INTERVAL 1 MINUTE * (o_orderkey % 1440)"


def written_dates(spark, sf) -> DataFrame:
    moment = "timestampadd(MINUTE, o_orderkey % 1440, cast(cast(o_orderdate AS date) AS timestamp))"
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS row_key", *[f"date_format({moment}, '{p}') AS {c}" for c, (p, _) in WRITTEN.items()])
