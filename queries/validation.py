"""Validation: one query per expectation, whole suites, failing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.constants import (
    BETWEEN,
    DATEUTIL,
    EMAIL_REGEX,
    IN_SET,
    NOT_NULL,
    OF_TYPE,
    REGEX,
    UNIQUE,
)
from dataward.operators import classify, rules, validate
from queries.fixtures import AS_OF, oracle, table
from queries.profiling import (
    GENERATED,
    profiles,
    typed_cte,
)
from queries.registry import query
from queries.sqlparts import NOW, safe_double, safe_ts

STATUSES = ["pending", "processing", "shipped", "delivered"]
PHONE = r"^\+1-\d{3}-\d{3}-\d{4}$"


def rule(order, kind, column, low=None, high=None, values=None, regex=None, type_=None):
    return {"rule_order": order, "expectation_type": kind, "column_name": column,
            "min_value": low, "max_value": high, "value_set": values or [], "regex": regex,
            "type_": type_, "reasoning": f"rule {order}"}


def outside(value: str, low: str | None, high: str | None) -> str:
    tests = [t for t in (low and f"{value} < {low}", high and f"{value} > {high}") if t]
    return " OR ".join(f"coalesce({t}, false)" for t in tests)


# name -> (input, [(rule, SQL test for a failing row)])
SUITES = {
    "not_null": ("dirty_orders", [
        (rule(1, NOT_NULL, "email"), "email IS NULL"),
        (rule(2, NOT_NULL, "status"), "status IS NULL")]),
    "between_number": ("dirty_orders", [
        (rule(1, BETWEEN, "quantity", "0", "8"), outside("quantity", "0", "8")),
        (rule(2, BETWEEN, "order_amount", "1000.5", None),
         outside("order_amount", "1000.5", None)),
        (rule(3, BETWEEN, "order_amount", "low", "1e5"),
         outside("order_amount", None, "100000"))]),
    "between_text_number": ("dirty_patients", [
        (rule(1, BETWEEN, "age", "0", "120"), outside(safe_double("age"), "0", "120")),
        (rule(2, BETWEEN, "total_cost", "0", None), outside(safe_double("total_cost"), "0", None))]),
    "between_date": ("dirty_orders", [
        (rule(1, BETWEEN, "order_date", "1900-01-01", "today"),
         outside(safe_ts("order_date"), "TIMESTAMP '1900-01-01'", NOW)),
        (rule(2, BETWEEN, "order_date", "1997-06-01", "no-bound"),
         outside(safe_ts("order_date"), "TIMESTAMP '1997-06-01'", None))]),
    "in_set": ("dirty_orders", [
        (rule(1, IN_SET, "status", values=STATUSES),
         "status IS NOT NULL AND status NOT IN ('pending', 'processing', 'shipped', 'delivered')"),
        (rule(2, IN_SET, "quantity", values=["1", "2", "3.0", "x"]), "quantity NOT IN (1, 2, 3)"),
        (rule(3, IN_SET, "product", values=["Laptop", "Phone"]),
         "product NOT IN ('Laptop', 'Phone')")]),
    "regex": ("dirty_patients", [
        (rule(1, REGEX, "email", regex=EMAIL_REGEX),
         f"email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_REGEX}')"),
        (rule(2, REGEX, "phone", regex=PHONE), f"NOT regexp_matches(phone, '{PHONE}')"),
        (rule(3, REGEX, "department", regex="Card"), "NOT starts_with(department, 'Card')"),
        (rule(4, REGEX, "department", regex="(broken"), "false")]),
    "of_type": ("dirty_patients", [
        (rule(1, OF_TYPE, "age", type_="int"), f"({safe_double('age')}) IS NULL"),
        (rule(2, OF_TYPE, "total_cost", type_="number"), f"({safe_double('total_cost')}) IS NULL"),
        (rule(3, OF_TYPE, "discharge_status", type_="float"), "true"),
        (rule(4, OF_TYPE, "department", type_="str"), "false")]),
    "dateutil": ("dirty_patients", [
        (rule(1, DATEUTIL, "admission_date"),
         f"admission_date IS NOT NULL AND ({safe_ts('admission_date')}) IS NULL")]),
}


def counted_sql(items, src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT cast({r['rule_order']} AS bigint) AS rule_order, '{r['expectation_type']}' AS "
        f"expectation_type, '{r['column_name']}' AS column_name, "
        f"count(*) FILTER ({test}) AS failing_count, "
        f"count(*) FILTER ({test}) = 0 AS success FROM {src}" for r, test in items)


def _register(name, source, items):
    @query(f"validate_{name}", oracle(counted_sql(items, source), source))
    def run(spark, sf):
        return validate.validate(table(spark, sf, source), [r for r, _ in items], AS_OF).select(
            "rule_order", "expectation_type", "column_name", "failing_count", "success")


for _name, (_source, _items) in SUITES.items():
    _register(_name, _source, _items)


def dup_count(column: str, src: str) -> str:
    return (f"(SELECT coalesce(cast(sum(n) AS bigint), 0) FROM (SELECT count(*) AS n FROM {src} "
            f"GROUP BY {column}) WHERE n > 1)")


@query("validate_unique", oracle(f"""
SELECT cast(1 AS bigint) AS rule_order, 'order_id' AS column_name,
 {dup_count('order_id', 'dirty_orders')} AS failing_count
UNION ALL SELECT 2, 'row_key', {dup_count('row_key', 'dirty_orders')}
UNION ALL SELECT 3, 'email', {dup_count('email', 'dirty_orders')}
UNION ALL SELECT 4, 'order_amount', {dup_count('order_amount', 'dirty_orders')}""",
    "dirty_orders"))
def validate_unique(spark, sf):
    """Members of repeated groups, nulls being equal; email holds a hot null group."""
    return validate.validate(table(spark, sf, "dirty_orders"), [
        rule(1, UNIQUE, "order_id"), rule(2, UNIQUE, "row_key"), rule(3, UNIQUE, "email"),
        rule(4, UNIQUE, "order_amount")], AS_OF).select(
        "rule_order", "column_name", "failing_count")


# The suite used for dirty orders from here on: (rule, failing test); unique has no test.
ORDER_SUITE = [
    (rule(1, NOT_NULL, "email"), "email IS NULL"),
    (rule(2, REGEX, "email", regex=EMAIL_REGEX),
     f"email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_REGEX}')"),
    (rule(3, BETWEEN, "quantity", "0", "100"), outside("quantity", "0", "100")),
    (rule(4, BETWEEN, "order_amount", "0", "1000000"), outside("order_amount", "0", "1000000")),
    (rule(5, BETWEEN, "order_date", "1900-01-01", "today"),
     outside(safe_ts("order_date"), "TIMESTAMP '1900-01-01'", NOW)),
    (rule(6, DATEUTIL, "order_date"),
     f"order_date IS NOT NULL AND ({safe_ts('order_date')}) IS NULL"),
    (rule(7, IN_SET, "status", values=STATUSES),
     "status IS NOT NULL AND status NOT IN ('pending', 'processing', 'shipped', 'delivered')"),
]
ORDER_UNIQUE = rule(8, UNIQUE, "order_id")
ORDER_RULES = [r for r, _ in ORDER_SUITE] + [ORDER_UNIQUE]
EXTRA = [rule(9, NOT_NULL, "no_such_column"), rule(10, "expect_magic", "status")]
RESULTS = (counted_sql(ORDER_SUITE, "dirty_orders") + f"""
UNION ALL SELECT 8, '{UNIQUE}', 'order_id', {dup_count('order_id', 'dirty_orders')},
 {dup_count('order_id', 'dirty_orders')} = 0""")
WITH_EXTRA = RESULTS + f"""
UNION ALL SELECT 9, '{NOT_NULL}', 'no_such_column', 0, true
UNION ALL SELECT 10, 'expect_magic', 'status', 0, false"""


@query("validate_suite", oracle(f"""SELECT *, CASE rule_order
 WHEN 9 THEN 'Column ''no_such_column'' not found in dataset — skipped'
 WHEN 10 THEN 'Unknown expectation type: expect_magic' END AS error FROM ({WITH_EXTRA})""",
    "dirty_orders"))
def validate_suite(spark, sf):
    return validate.validate(table(spark, sf, "dirty_orders"), ORDER_RULES + EXTRA, AS_OF).select(
        "rule_order", "expectation_type", "column_name", "failing_count", "success", "error")


@query("suite_statistics", oracle(f"""
SELECT count(*) AS evaluated_expectations, count(*) FILTER (success) AS successful_expectations,
 count(*) FILTER (NOT success) AS unsuccessful_expectations,
 round(count(*) FILTER (success) / count(*) * 100, 1) AS success_percent,
 bool_and(success) AS success FROM ({WITH_EXTRA})""", "dirty_orders"))
def suite_statistics(spark, sf):
    return validate.suite_statistics(
        validate.validate(table(spark, sf, "dirty_orders"), ORDER_RULES + EXTRA, AS_OF))


FAILING = " UNION ALL ".join(
    f"SELECT cast({r['rule_order']} AS bigint) AS rule_order, row_key AS key, "
    f"cast({r['column_name']} AS varchar) AS value FROM dirty_orders WHERE {test}"
    for r, test in ORDER_SUITE if r["column_name"] != "order_amount") + """
 UNION ALL SELECT 8, row_key, cast(order_id AS varchar) FROM dirty_orders WHERE order_id IN
 (SELECT order_id FROM dirty_orders GROUP BY 1 HAVING count(*) > 1)"""
FAILING_RULES = [r for r in ORDER_RULES if r["column_name"] != "order_amount"]


@query("failing_rows", oracle(FAILING, "dirty_orders"))
def failing_rows(spark, sf):
    return validate.failing_rows(
        table(spark, sf, "dirty_orders"), FAILING_RULES, "row_key", AS_OF).select(
        "rule_order", "key", "value")


@query("failing_keys", oracle(f"""SELECT rule_order, key, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY rule_order ORDER BY key) AS rank FROM ({FAILING}))
WHERE rank <= 50""", "dirty_orders"))
def failing_keys(spark, sf):
    return validate.failing_keys(
        table(spark, sf, "dirty_orders"), FAILING_RULES, "row_key", AS_OF).select(
        "rule_order", "key", F.col("rank").cast("bigint").alias("rank"))


EARLY_OR_LATE = outside(safe_ts("order_date"), "TIMESTAMP '1900-01-01'", NOW)
# Every generated rule kind counted per column of dirty orders, then joined to the rules.
CANDIDATES = []
for _c in ("row_key", "order_id", "customer_id", "customer_name", "email", "product",
           "quantity", "order_amount", "order_date", "status"):
    _given = f"({safe_ts(_c)})" if _c == "order_date" else _c     # text that is no date is null
    CANDIDATES += [
        f"SELECT '{_c}' AS column_name, '{NOT_NULL}' AS expectation_type, "
        f"count(*) FILTER ({_given} IS NULL) AS failing_count FROM dirty_orders",
        f"SELECT '{_c}', '{UNIQUE}', {dup_count(_c, 'dirty_orders')}"]
for _c in ("row_key", "order_id", "customer_id", "quantity", "order_amount"):
    CANDIDATES.append(
        f"SELECT '{_c}', '{BETWEEN}', (SELECT count(*) FROM dirty_orders d JOIN generated g ON "
        f"g.column_name = '{_c}' AND g.expectation_type = '{BETWEEN}' "
        f"WHERE d.{_c} < g.min_number OR d.{_c} > g.max_number)")
CANDIDATES.append(
    f"SELECT 'order_date', '{BETWEEN}', (SELECT count(*) FROM dirty_orders WHERE "
    f"{EARLY_OR_LATE})")
CANDIDATES.append(
    f"SELECT 'email', '{REGEX}', (SELECT count(*) FROM dirty_orders WHERE email IS NOT NULL "
    f"AND NOT regexp_matches(email, '{EMAIL_REGEX}'))")
for _c in ("customer_name", "product", "status"):
    CANDIDATES.append(
        f"SELECT '{_c}', '{IN_SET}', (SELECT count(*) FROM dirty_orders d JOIN generated g ON "
        f"g.column_name = '{_c}' AND g.expectation_type = '{IN_SET}' "
        f"WHERE d.{_c} NOT IN (SELECT unnest(string_split(g.value_set, '|'))))")


@query("validate_generated_suite", oracle(f"""
SELECT g.column_name, g.expectation_type, c.failing_count, c.failing_count = 0 AS success
FROM generated g JOIN ({" UNION ALL ".join(CANDIDATES)}) c USING (column_name, expectation_type)
""", "dirty_orders", ctes=typed_cte("dirty_orders") | {"generated": GENERATED}))
def validate_generated_suite(spark, sf):
    """Profile the dirty orders, derive rules from the profile, count what breaks them."""
    typed = classify.with_semantic_types(profiles(spark, sf, "dirty_orders"))
    rows = typed.collect()                                     # one row per column
    typed = spark.createDataFrame(rows, typed.schema)
    return validate.validate(
        table(spark, sf, "dirty_orders"), rules.build_suite(typed), AS_OF,
        {r.column_name: r.semantic_type for r in rows}).select(
        "column_name", "expectation_type", "failing_count", "success")


@query("validate_not_null_date", oracle(f"""
SELECT 1::BIGINT AS rule_order, count(*) FILTER (({safe_ts('order_date')}) IS NULL) AS failing_count FROM dirty_orders
UNION ALL SELECT 2, coalesce((SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM dirty_orders
 GROUP BY {safe_ts('order_date')}) WHERE n > 1), 0)""", "dirty_orders"))
def validate_not_null_date(spark, sf):
    """Text that is no date counts as missing, as it does in the profile."""
    return validate.validate(table(spark, sf, "dirty_orders"), [
        rule(1, NOT_NULL, "order_date"), rule(2, UNIQUE, "order_date")], AS_OF).select(
        "rule_order", "failing_count")


def with_nan(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS row_key",
        "CASE WHEN o_orderkey % 9 = 4 THEN double('NaN') ELSE o_totalprice END AS price")


@query("validate_nan", """
SELECT 1::BIGINT AS rule_order, count(*) FILTER (o_orderkey % 9 = 4) AS failing_count FROM orders
UNION ALL SELECT 2, 0 UNION ALL SELECT 3, 0""")
def validate_nan(spark, sf):
    """NaN is a missing value: it fails only where one may not be missing."""
    return validate.validate(with_nan(spark, sf), [
        rule(1, NOT_NULL, "price"), rule(2, BETWEEN, "price", "0", "10000000"),
        rule(3, REGEX, "price", regex=r"(?P<whole_part>\d+)\.?.*\Z")], AS_OF).select(
        "rule_order", "failing_count")


@query("validate_in_set_bigint", """
SELECT 1::BIGINT AS rule_order, count(*) FILTER (o_orderkey % 2 = 1) AS failing_count FROM orders
UNION ALL SELECT 2, count(*) FILTER (o_orderkey % 2 = 0) FROM orders""")
def validate_in_set_bigint(spark, sf):
    """Neighbours beyond the precision of a double, whole and with decimals."""
    df = table(spark, sf, "orders").selectExpr(
        "9007199254740992 + o_orderkey % 2 AS n",
        "cast(90071992547409921.01 + o_orderkey % 2 AS decimal(30, 2)) AS d")
    return validate.validate(df, [
        rule(1, IN_SET, "n", values=["9007199254740992", "x"]),
        rule(2, IN_SET, "d", values=["90071992547409922.01"])], AS_OF).select("rule_order", "failing_count")


@query("failing_rows_no_rules", "SELECT NULL::BIGINT AS rule_order, NULL::BIGINT AS key FROM orders WHERE false")
def failing_rows_no_rules(spark, sf):
    return validate.failing_rows(table(spark, sf, "orders"), [rule(1, NOT_NULL, "no_such_column")],
                                 "o_orderkey", AS_OF).select("rule_order", "key")


@query("validate_unique_signed_zero", """
SELECT t.rule_order, t.column_name, (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders
  GROUP BY o_custkey % 1000 + (o_orderkey // 4) * 1000, t.rule_order HAVING count(*) > 1)) AS failing_count
FROM (VALUES (1::BIGINT, 'amount')) t(rule_order, column_name)
UNION ALL SELECT 2, 'zero', count(*) FILTER (o_orderkey % 3 <> 2) FROM orders""")
def validate_unique_signed_zero(spark, sf):
    """0.0 and -0.0 are one value; every third row has a value of its own."""
    df = table(spark, sf, "orders").selectExpr(
        "cast(o_custkey % 1000 + (o_orderkey div 4) * 1000 AS double) AS amount",
        "CASE o_orderkey % 3 WHEN 0 THEN 0.0D WHEN 1 THEN -0.0D ELSE cast(o_orderkey + 1 AS double) END AS zero")
    return validate.validate(df, [rule(1, UNIQUE, "amount"), rule(2, UNIQUE, "zero")], AS_OF).select(
        "rule_order", "column_name", "failing_count")


@query("validate_unique_array", """
SELECT 1::BIGINT AS rule_order, o_orderkey AS key FROM orders WHERE o_orderkey % 10 IN (3, 4)""")
def validate_unique_array(spark, sf):
    """Arrays whose texts look alike are different; equal ones are found, in rows as in counts."""
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", """CASE o_orderkey % 10 WHEN 0 THEN array(concat('a, b', cast(o_orderkey AS string)))
 WHEN 1 THEN array('a', concat('b', cast(o_orderkey - 1 AS string)))
 WHEN 3 THEN array('same') WHEN 4 THEN array('same') ELSE array(cast(o_orderkey AS string), 'x') END AS items""")
    rules_ = [rule(1, UNIQUE, "items")]
    rows = validate.failing_rows(df, rules_, "o_orderkey", AS_OF)
    counted = validate.validate(df, rules_, AS_OF).select("failing_count")
    return rows.where(F.lit(rows.count()) == counted.scalar()).select("rule_order", "key")


LARGE_SET = 200_000


@query("validate_in_set_large", f"""
SELECT 1::BIGINT AS rule_order, 'o_custkey' AS column_name, count(*) FILTER (o_custkey % 3 = 0) AS failing_count FROM orders
UNION ALL SELECT 2, 'code', count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey // 7 >= {LARGE_SET}) FROM orders
UNION ALL SELECT 3, 'price', count(*) FILTER (o_totalprice >= {LARGE_SET}) FROM orders""")
def validate_in_set_large(spark, sf):
    """Sets of 200,000 whole numbers, texts and decimals."""
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_custkey", "concat(cast(o_orderkey div 7 AS string), CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END) AS code",
        "cast(floor(o_totalprice) AS decimal(18, 2)) AS price")
    numbers = range(LARGE_SET)
    return validate.validate(df, [
        rule(1, IN_SET, "o_custkey", values=[k for k in range(LARGE_SET * 3 // 2) if k % 3]),
        rule(2, IN_SET, "code", values=[str(k) for k in numbers]),
        rule(3, IN_SET, "price", values=[f"{k}.0" for k in numbers])], AS_OF).select(
        "rule_order", "column_name", "failing_count")


@query("failing_rows_large_set", """
SELECT 1::BIGINT AS rule_order, 'expect_column_values_to_be_in_set' AS expectation_type, 'o_custkey' AS column_name,
 o_orderkey AS key, o_custkey::VARCHAR AS value FROM orders WHERE o_custkey % 3 = 0""")
def failing_rows_large_set(spark, sf):
    values = [k for k in range(LARGE_SET * 3 // 2) if k % 3]
    return validate.failing_rows(table(spark, sf, "orders"), [rule(1, IN_SET, "o_custkey", values=values)],
                                 "o_orderkey", AS_OF)
