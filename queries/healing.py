"""Repairs, set-aside rows, action plans and the validate-heal loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.constants import EMAIL_REGEX
from dataward.operators import actions, heal, reports, validate
from dataward.plans.quality_run import quality_run
from queries.fixtures import AS_OF, oracle, table
from queries.registry import query
from queries.sqlparts import NOW, safe_double, safe_ts
from queries.profiling import WIDE, wide
from queries.validation import ORDER_RULES, RESULTS, STATUSES, rule, with_nan

STATUS_SET = "('pending', 'processing', 'shipped', 'delivered')"
BAD_EMAIL = f"email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL_REGEX}')"
BAD_DATE = (f"({safe_ts('order_date')}) IS NULL OR ({safe_ts('order_date')}) > {NOW} "
            f"OR ({safe_ts('order_date')}) < TIMESTAMP '1900-01-01'")


def healed(spark, sf, source, *plan, **options):
    return heal.heal(table(spark, sf, source), list(plan), "row_key", AS_OF, **options)


def act(kind, column, **more):
    return {"action_type": kind, "column": column, **more}


def quarantine(column, condition, **more):
    return act("quarantine", column, condition=condition,
               reason=f"{condition} in {column}", **more)


# ---- fixes --------------------------------------------------------------------

@query("heal_abs", oracle("""
SELECT row_key, abs(quantity) AS quantity, abs(order_amount) AS order_amount
FROM dirty_orders""", "dirty_orders"))
def heal_abs(spark, sf):
    return healed(spark, sf, "dirty_orders", act("fix_value", "quantity", operation="abs"),
                  act("fix_value", "order_amount", operation="abs")).clean.select(
        "row_key", "quantity", "order_amount")


@query("heal_abs_text", oracle(f"""
SELECT row_key, CASE WHEN ({safe_double('total_cost')}) < 0
 THEN cast(abs({safe_double('total_cost')}) AS varchar) ELSE total_cost END AS total_cost
FROM dirty_patients""", "dirty_patients"))
def heal_abs_text(spark, sf):
    return healed(spark, sf, "dirty_patients", act("fix_value", "total_cost", operation="abs")
                  ).clean.select("row_key", "total_cost")


@query("heal_categorical", oracle(f"""
SELECT row_key, CASE WHEN status IN {STATUS_SET} THEN status ELSE 'pending' END AS status,
 product FROM dirty_orders""", "dirty_orders"))
def heal_categorical(spark, sf):
    """The second action has no valid values and changes nothing."""
    return healed(
        spark, sf, "dirty_orders",
        act("fix_value", "status", operation="replace_invalid_categorical",
            valid_values=STATUSES, default_value="pending"),
        act("fix_value", "product", operation="replace_invalid_status")).clean.select(
        "row_key", "status", "product")


@query("heal_empty", oracle("""
SELECT row_key, CASE WHEN status = '' THEN 'unknown' ELSE status END AS status
FROM dirty_orders""", "dirty_orders"))
def heal_empty(spark, sf):
    return healed(spark, sf, "dirty_orders", act(
        "fix_value", "status", operation="replace_empty_string", default_value="unknown")
    ).clean.select("row_key", "status")


# ---- quarantine ----------------------------------------------------------------

# name -> (input, action, SQL test of a row that is set aside)
CONDITIONS = {
    "is_null": ("dirty_orders", quarantine("email", "is_null"), "email IS NULL"),
    "is_future_date": ("dirty_orders", quarantine("order_date", "is_future_date"), BAD_DATE),
    "not_a_number": (
        "dirty_patients", quarantine("age", "is_future_date"),
        f"age IS NOT NULL AND ({safe_double('age')}) IS NULL"),
    "is_duplicate": (
        "dirty_orders", quarantine("order_id", "is_duplicate"),
        "row_key <> (SELECT min(d.row_key) FROM dirty_orders d WHERE d.order_id = s.order_id)"),
    "out_of_bounds": (
        "dirty_patients", quarantine("age", "out_of_bounds", min_bound="0", max_bound=120),
        f"coalesce(({safe_double('age')}) < 0 OR ({safe_double('age')}) > 120, false)"),
    "out_of_bounds_open": (
        "dirty_patients", quarantine("total_cost", "out_of_bounds"),
        f"total_cost IS NOT NULL AND ({safe_double('total_cost')}) IS NULL"),
    "fails_regex": (
        "dirty_orders", quarantine("email", "not_matches_regex", regex=EMAIL_REGEX), BAD_EMAIL),
}


def _register(name, source, action, test):
    reason = action["reason"].replace("'", "''")

    @query(f"quarantine_{name}", oracle(
        f"SELECT s.row_key, CASE WHEN {test} THEN '{reason}' END AS reject_reason "
        f"FROM {source} s", source))
    def run(spark, sf):
        done = healed(spark, sf, source, action)
        kept = done.clean.select("row_key", F.lit(None).cast("string").alias("reject_reason"))
        return kept.unionByName(done.quarantined.select("row_key", "reject_reason"))


for _name, _args in CONDITIONS.items():
    _register(_name, *_args)


@query("quarantine_guard", oracle("""
SELECT row_key, CASE WHEN email IS NULL THEN 'is_null in email' END AS reject_reason
FROM dirty_patients""", "dirty_patients"))
def quarantine_guard(spark, sf):
    """60 % of discharge_status is null: that action is called off, the next one works."""
    done = healed(spark, sf, "dirty_patients", quarantine("discharge_status", "is_null"),
                  quarantine("email", "is_null"))
    return done.clean.select("row_key", F.lit(None).cast("string").alias(
        "reject_reason")).unionByName(done.quarantined.select("row_key", "reject_reason"))


@query("dedup_keep_first", oracle("""
SELECT row_key, order_id, status FROM (SELECT *, row_number() OVER (
 PARTITION BY order_id ORDER BY row_key) AS place FROM dirty_orders) WHERE place = 1""",
    "dirty_orders"))
def dedup_keep_first(spark, sf):
    return healed(spark, sf, "dirty_orders", act("deduplicate", "order_id")).clean.select(
        "row_key", "order_id", "status")


@query("dedup_hot_group", oracle("""
SELECT row_key, discharge_status FROM (SELECT *, row_number() OVER (
 PARTITION BY discharge_status ORDER BY row_key) AS place FROM dirty_patients)
WHERE place = 1""", "dirty_patients"))
def dedup_hot_group(spark, sf):
    """Two values, one of them null in 60 % of the rows."""
    return healed(spark, sf, "dirty_patients", act("deduplicate", "discharge_status")
                  ).clean.select("row_key", "discharge_status")


SEQUENCE = [
    act("fix_value", "quantity", operation="abs"),
    quarantine("quantity", "out_of_bounds", min_bound=2, max_bound=9),
    quarantine("email", "is_null"),
    act("fix_value", "order_amount", operation="abs"),
    quarantine("order_date", "is_future_date"),
    act("deduplicate", "order_id"),
    act("fix_value", "status", operation="replace_invalid_categorical",
        valid_values=STATUSES, default_value="pending"),
    quarantine("email", "fails_regex", regex=EMAIL_REGEX),
    act("fix_value", "no_such_column", operation="abs"),
    act("shred", "status"),
]
SEQUENCE_CTES = {
    "s1": f"""SELECT *, abs(quantity) AS q, CASE
 WHEN abs(quantity) < 2 OR abs(quantity) > 9 THEN 'out_of_bounds in quantity'
 WHEN email IS NULL THEN 'is_null in email'
 WHEN {BAD_DATE} THEN 'is_future_date in order_date' END AS r1 FROM dirty_orders""",
    "s2": """SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY row_key) AS place
FROM s1 WHERE r1 IS NULL""",
    "s3": f"""SELECT *, CASE WHEN {BAD_EMAIL} THEN 'fails_regex in email' END AS r2
FROM s2 WHERE place = 1""",
}
SEQUENCE_OUT = f"""
SELECT row_key, q AS quantity, CASE WHEN r1 LIKE 'is_future%' THEN abs(order_amount)
 ELSE order_amount END AS order_amount, status, r1 AS reject_reason FROM s1 WHERE r1 IS NOT NULL
UNION ALL SELECT row_key, q, abs(order_amount),
 CASE WHEN status IN {STATUS_SET} THEN status ELSE 'pending' END, r2 FROM s3"""


@query("heal_sequence", oracle(SEQUENCE_OUT, "dirty_orders", ctes=SEQUENCE_CTES))
def heal_sequence(spark, sf):
    """Fixes and set-aside rows interleaved: a rejected row keeps the values it then had."""
    done = healed(spark, sf, "dirty_orders", *SEQUENCE)
    columns = ["row_key", "quantity", "order_amount", "status"]
    return done.clean.select(*columns, F.lit(None).cast("string").alias(
        "reject_reason")).unionByName(done.quarantined.select(*columns, "reject_reason"))


@query("heal_sequence_stats", oracle("""
SELECT * FROM (
 SELECT 1::bigint AS step, count(*) FILTER (quantity < 0) AS rows_affected, count(*) AS remaining_rows, true AS success FROM s1
 UNION ALL SELECT 2, count(*) FILTER (r1 LIKE 'out%'), count(*) FILTER (r1 IS NULL OR r1 NOT LIKE 'out%'), true FROM s1
 UNION ALL SELECT 3, count(*) FILTER (r1 LIKE 'is_null%'), count(*) FILTER (r1 IS NULL OR r1 LIKE 'is_future%'), true FROM s1
 UNION ALL SELECT 4, count(*) FILTER (order_amount < 0 AND (r1 IS NULL OR r1 LIKE 'is_future%')), count(*) FILTER (r1 IS NULL OR r1 LIKE 'is_future%'), true FROM s1
 UNION ALL SELECT 5, count(*) FILTER (r1 LIKE 'is_future%'), count(*) FILTER (r1 IS NULL), true FROM s1
 UNION ALL SELECT 6, count(*) FILTER (place > 1), count(*) FILTER (place = 1), true FROM s2
 UNION ALL SELECT 7, count(*) FILTER (status NOT IN ('pending', 'processing', 'shipped', 'delivered')), count(*), true FROM s3
 UNION ALL SELECT 8, count(r2), count(*) FILTER (r2 IS NULL), true FROM s3
 UNION ALL SELECT 9, 0, count(*) FILTER (r2 IS NULL), false FROM s3
 UNION ALL SELECT 10, 0, count(*) FILTER (r2 IS NULL), true FROM s3)""",
    "dirty_orders", ctes=SEQUENCE_CTES))
def heal_sequence_stats(spark, sf):
    done = healed(spark, sf, "dirty_orders", *SEQUENCE)
    return spark.createDataFrame(
        [(i, s["rows_affected"], s["remaining_rows"], s["success"])
         for i, s in enumerate(done.stats, 1)],
        "step bigint, rows_affected bigint, remaining_rows bigint, success boolean")


# ---- plans ---------------------------------------------------------------------

TYPES = [("row_key", "integer"), ("order_id", "integer"), ("email", "email"),
         ("quantity", "integer"), ("order_amount", "currency"), ("order_date", "datetime"),
         ("status", "categorical"), ("balance", "currency")]


def order_results(spark, sf):
    """Validation of the dirty orders, with a signed column among them."""
    df = table(spark, sf, "dirty_orders").withColumn("balance", F.col("order_amount"))
    more = [rule(9, "expect_column_values_to_be_between", "balance", "0", "1000000"),
            rule(10, "expect_column_values_to_be_of_type", "email", type_="int"),
            rule(11, "expect_column_values_to_be_in_set", "product")]
    results = validate.validate(df, ORDER_RULES + more, AS_OF)
    return results, spark.createDataFrame(TYPES, "column_name string, semantic_type string")


PLAN_RESULTS = RESULTS + """
UNION ALL SELECT 9, 'expect_column_values_to_be_between', 'balance',
 count(*) FILTER (order_amount < 0 OR order_amount > 1000000),
 count(*) FILTER (order_amount < 0 OR order_amount > 1000000) = 0 FROM dirty_orders
UNION ALL SELECT 10, 'expect_column_values_to_be_of_type', 'email', count(*), count(*) = 0 FROM dirty_orders
UNION ALL SELECT 11, 'expect_column_values_to_be_in_set', 'product', count(*), count(*) = 0 FROM dirty_orders"""
PLAN_OUT = ["column_name", "failure_type", "action_type", "operation", "condition",
            "min_bound", "max_bound", "valid_values", "default_value", "regex"]
EXPECTED_PLAN = f"""SELECT rule_order AS step, column_name, expectation_type AS failure_type,
 CASE rule_order WHEN 3 THEN 'fix_value' WHEN 4 THEN 'fix_value' WHEN 7 THEN 'fix_value'
  WHEN 8 THEN 'deduplicate' ELSE 'quarantine' END AS action_type,
 CASE rule_order WHEN 3 THEN 'abs' WHEN 4 THEN 'abs' WHEN 7 THEN 'replace_invalid_categorical' END AS operation,
 CASE rule_order WHEN 1 THEN 'is_null' WHEN 2 THEN 'fails_regex' WHEN 5 THEN 'is_future_date'
  WHEN 6 THEN 'is_null' WHEN 9 THEN 'out_of_bounds' WHEN 10 THEN 'is_null' WHEN 11 THEN 'is_null' END AS condition,
 CASE rule_order WHEN 9 THEN '0' END AS min_bound,
 CASE rule_order WHEN 9 THEN '1000000' END AS max_bound,
 CASE rule_order WHEN 7 THEN 'pending|processing|shipped|delivered' END AS valid_values,
 CASE rule_order WHEN 7 THEN 'pending' END AS default_value,
 CASE rule_order WHEN 2 THEN '{EMAIL_REGEX}' END AS regex
FROM ({PLAN_RESULTS}) WHERE NOT success"""


def plan_columns(plan):
    return plan.withColumn("valid_values", F.array_join("valid_values", "|")).select(
        "step", *PLAN_OUT)


@query("plan_actions", oracle(EXPECTED_PLAN, "dirty_orders"))
def plan_actions(spark, sf):
    return plan_columns(actions.plan_actions(*order_results(spark, sf)))


CONFIDENCE = """CASE WHEN action_type = 'deduplicate' THEN 0.95
 WHEN condition = 'is_null' THEN 0.99 WHEN condition = 'is_duplicate' THEN 0.97
 WHEN condition = 'is_future_date' THEN 0.92 WHEN condition = 'out_of_bounds' THEN 0.75
 WHEN operation = 'abs' THEN 0.82 WHEN operation = 'replace_empty_string' THEN 0.65
 WHEN operation IS NOT NULL THEN 0.7 ELSE 0.5 END"""


@query("repair_confidence", oracle(
    f"SELECT column_name, cast(max({CONFIDENCE}) AS double) AS confidence "
    f"FROM ({EXPECTED_PLAN}) GROUP BY column_name", "dirty_orders"))
def repair_confidence(spark, sf):
    return actions.repair_confidence(actions.plan_actions(*order_results(spark, sf)))


# One proposal per way a user's action is replaced or completed.
PROPOSED = [
    # order, column, failure_type, action, operation, condition, values, default, reason
    (1, "email", "not_null", "delete_rows", None, None, None, None, None),
    (2, "email", "expect_column_values_to_match_regex", "fix_value",
     "replace_invalid_categorical", None, ["x"], "x", None),
    (3, "quantity", "within_range", "fix_value", "negate", None, None, None, None),
    (4, "order_date", "within_range", "quarantine", None, "is_null", None, None, "mine"),
    (5, "balance", "within_range", "fix_value", "abs", None, None, None, None),
    (6, "status", "in_set", "fix_value", "replace_invalid_status", None, ["?"], "shipped", None),
    (7, "order_id", "unique", "quarantine", None, None, None, None, None),
    (8, "order_amount", "within_range", "fix_value", "abs", None, None, None, "mine"),
    (9, "product", "in_set", "fix_value", "replace_invalid_categorical", None, None, None, None),
    (10, "row_key", None, "quarantine", None, "is_null", None, None, "no failed rule"),
]


def proposed_actions(spark):
    rows = [(o, c, f, a, op, cond, None, None, v, d, None, r, None)
            for o, c, f, a, op, cond, v, d, r in PROPOSED]
    return spark.createDataFrame(rows, actions.PROPOSAL_SCHEMA)


SCREENED = f"""
SELECT * FROM (VALUES
 (1, 'email', 'expect_column_values_to_not_be_null', 'quarantine', NULL, 'is_null', NULL, NULL, NULL, NULL, NULL),
 (2, 'email', 'expect_column_values_to_match_regex', 'quarantine', NULL, 'fails_regex', NULL, NULL, NULL, NULL, '{EMAIL_REGEX}'),
 (3, 'quantity', 'expect_column_values_to_be_between', 'fix_value', 'abs', NULL, NULL, NULL, NULL, NULL, NULL),
 (4, 'order_date', 'expect_column_values_to_be_between', 'quarantine', NULL, 'is_future_date', NULL, NULL, NULL, NULL, NULL),
 (5, 'balance', 'expect_column_values_to_be_between', 'quarantine', NULL, 'out_of_bounds', '0', '1000000', NULL, NULL, NULL),
 (6, 'status', 'expect_column_values_to_be_in_set', 'fix_value', 'replace_invalid_status', NULL, NULL, NULL, 'pending|processing|shipped|delivered', 'shipped', NULL),
 (7, 'order_id', 'expect_column_values_to_be_unique', 'quarantine', NULL, 'is_duplicate', NULL, NULL, NULL, NULL, NULL),
 (8, 'order_amount', 'expect_column_values_to_be_between', 'fix_value', 'abs', NULL, NULL, NULL, NULL, NULL, NULL),
 (9, 'product', 'expect_column_values_to_be_in_set', 'quarantine', NULL, 'is_null', NULL, NULL, NULL, NULL, NULL),
 (10, 'row_key', NULL, 'quarantine', NULL, 'is_null', NULL, NULL, NULL, NULL, NULL))
 t({", ".join(["step", *PLAN_OUT])})
UNION ALL SELECT 1000000 + step, {", ".join(PLAN_OUT)} FROM ({EXPECTED_PLAN}) WHERE step IN (6, 10)"""


@query("screen_actions", oracle(SCREENED, "dirty_orders"))
def screen_actions(spark, sf):
    """Proposals are checked against the failed rules; uncovered failures are added."""
    results, types = order_results(spark, sf)
    return plan_columns(actions.plan_actions(results, types, proposed_actions(spark)))


@query("skip_tried", oracle(f"""
SELECT step, column_name, action_type FROM ({EXPECTED_PLAN})
WHERE NOT (column_name = 'email' AND action_type = 'quarantine')
 AND NOT (column_name = 'quantity' AND action_type = 'fix_value')""", "dirty_orders"))
def skip_tried(spark, sf):
    history = spark.createDataFrame(
        [(1, "email", "quarantine", "is_null", 0, True, 0.99, None),
         (1, "quantity", "fix_value", "abs", 0, True, 0.82, None),
         (1, "status", "fix_value", "replace_invalid_categorical", 6, True, 0.7, None),
         (1, "order_id", "quarantine", "is_duplicate", 0, True, 0.97, None)],
        actions.HISTORY_SCHEMA)
    plan = actions.plan_actions(*order_results(spark, sf))
    return actions.skip_tried(plan, history).select("step", "column_name", "action_type")


# ---- the loop ------------------------------------------------------------------

LOOP_RULES = [r for r in ORDER_RULES if r["rule_order"] != 6]
MISSING = "Missing required value in ''email'' (null check failed)"
LOOP_CTES = {
    "l1": f"""SELECT *, CASE WHEN email IS NULL THEN '{MISSING}'
 WHEN {BAD_EMAIL} THEN 'Value in ''email'' failed regex validation — quarantining'
 WHEN {BAD_DATE} THEN 'Invalid date in ''order_date'' (out of valid range)' END AS reason
FROM dirty_orders""",
    "l2": """SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY row_key) AS place
FROM l1 WHERE reason IS NULL""",
}


def order_run(spark, sf, rules=None):
    types = spark.createDataFrame(
        [("dirty_orders", n, "object", t) for n, t in TYPES],
        "dataset string, column_name string, dtype string, semantic_type string")
    return quality_run(table(spark, sf, "dirty_orders"), "row_key", "dirty_orders", AS_OF,
                       rules=rules or LOOP_RULES, typed=types)


@query("heal_loop_clean", oracle(f"""
SELECT row_key, order_id, email, abs(quantity) AS quantity, abs(order_amount) AS order_amount,
 order_date, CASE WHEN status IN {STATUS_SET} THEN status ELSE 'pending' END AS status
FROM l2 WHERE place = 1""", "dirty_orders", ctes=LOOP_CTES))
def heal_loop_clean(spark, sf):
    return order_run(spark, sf).clean.select(
        "row_key", "order_id", "email", "quantity", "order_amount", "order_date", "status")


@query("heal_loop_quarantine", oracle("""
SELECT row_key, CASE WHEN reason LIKE 'Invalid%' THEN abs(quantity) ELSE quantity END AS quantity,
 status, reason AS reject_reason FROM l1 WHERE reason IS NOT NULL""",
    "dirty_orders", ctes=LOOP_CTES))
def heal_loop_quarantine(spark, sf):
    return order_run(spark, sf).quarantined.select(
        "row_key", "quantity", "status", "reject_reason")


@query("heal_loop_history", oracle("""
SELECT * FROM (
 SELECT 1::bigint AS iteration, 'email' AS column_name, 'quarantine' AS action_type, 'is_null' AS operation_or_condition,
  count(*) FILTER (reason LIKE 'Missing%') AS rows_affected, 0.99::double AS confidence FROM l1
 UNION ALL SELECT 1, 'email', 'quarantine', 'fails_regex', count(*) FILTER (reason LIKE 'Value%'), 0.5 FROM l1
 UNION ALL SELECT 1, 'quantity', 'fix_value', 'abs', count(*) FILTER (quantity < 0 AND (reason IS NULL OR reason LIKE 'Invalid%')), 0.82 FROM l1
 UNION ALL SELECT 1, 'order_amount', 'fix_value', 'abs', count(*) FILTER (order_amount < 0 AND (reason IS NULL OR reason LIKE 'Invalid%')), 0.82 FROM l1
 UNION ALL SELECT 1, 'order_date', 'quarantine', 'is_future_date', count(*) FILTER (reason LIKE 'Invalid%'), 0.92 FROM l1
 UNION ALL SELECT 1, 'status', 'fix_value', 'replace_invalid_categorical', count(*) FILTER (status NOT IN ('pending', 'processing', 'shipped', 'delivered')), 0.7 FROM l2
 UNION ALL SELECT 1, 'order_id', 'deduplicate', NULL, count(*) FILTER (place > 1), 0.95 FROM l2)""",
    "dirty_orders", ctes=LOOP_CTES))
def heal_loop_history(spark, sf):
    return order_run(spark, sf).history.select(
        "iteration", "column_name", "action_type", "operation_or_condition", "rows_affected",
        "confidence")


@query("healing_ledger", oracle("""
SELECT * FROM (
 SELECT 'email' AS "column", 'quarantine' AS action, 'is_null' AS detail,
  count(*) FILTER (reason LIKE 'Missing%') AS rows_affected,
  count(*) FILTER (reason IS NULL OR reason NOT LIKE 'Missing%') AS remaining_rows, '99%' AS confidence FROM l1
 UNION ALL SELECT 'email', 'quarantine', 'fails_regex', count(*) FILTER (reason LIKE 'Value%'), count(*) FILTER (reason IS NULL OR reason LIKE 'Invalid%'), '50%' FROM l1
 UNION ALL SELECT 'quantity', 'fix_value', 'abs', count(*) FILTER (quantity < 0 AND (reason IS NULL OR reason LIKE 'Invalid%')), count(*) FILTER (reason IS NULL OR reason LIKE 'Invalid%'), '82%' FROM l1
 UNION ALL SELECT 'order_amount', 'fix_value', 'abs', count(*) FILTER (order_amount < 0 AND (reason IS NULL OR reason LIKE 'Invalid%')), count(*) FILTER (reason IS NULL OR reason LIKE 'Invalid%'), '82%' FROM l1
 UNION ALL SELECT 'order_date', 'quarantine', 'is_future_date', count(*) FILTER (reason LIKE 'Invalid%'), count(*) FILTER (reason IS NULL), '92%' FROM l1
 UNION ALL SELECT 'status', 'fix_value', 'replace_invalid_categorical', count(*) FILTER (status NOT IN ('pending', 'processing', 'shipped', 'delivered')), count(*), '70%' FROM l2
 UNION ALL SELECT 'order_id', 'deduplicate', '—', count(*) FILTER (place > 1), count(*) FILTER (place = 1), '95%' FROM l2)""",
    "dirty_orders", ctes=LOOP_CTES))
def healing_ledger(spark, sf):
    return reports.healing_ledger(order_run(spark, sf).history).drop("reasoning")


@query("run_metrics", oracle("""
SELECT (SELECT count(*) FROM l2 WHERE place = 1) AS clean_rows,
 (SELECT count(*) FROM l1 WHERE reason IS NOT NULL) AS quarantined_rows,
 100::bigint AS pass_rate, 1::bigint AS cycles, 'PASS' AS status""",
    "dirty_orders", ctes=LOOP_CTES))
def run_metrics(spark, sf):
    run = order_run(spark, sf)
    return reports.run_metrics(run.clean, run.quarantined,
                               validate.suite_statistics(run.results), run.cycles, run.status)


# A range no repair can satisfy ends in an alert; text that is no date is set aside as null.
IS_DATE = f"({safe_ts('order_date')}) IS NOT NULL"
ALERT_RULES = [rule(1, "expect_column_values_to_be_between", "quantity", "0", "5"),
               rule(2, "expect_column_values_to_be_dateutil_parseable", "order_date")]


@query("heal_loop_alert", oracle(f"""
SELECT 'ALERT' AS status, 5::bigint AS cycles,
 (SELECT count(*) FILTER ({IS_DATE}) FROM dirty_orders) AS clean_rows,
 (SELECT count(*) FILTER (abs(quantity) > 5 AND {IS_DATE}) FROM dirty_orders) AS still_out_of_range,
 0::BIGINT AS still_unparseable""",
    "dirty_orders"))
def heal_loop_alert(spark, sf):
    run = order_run(spark, sf, ALERT_RULES)
    failing = {r.rule_order: r.failing_count for r in run.results.collect()}
    return run.clean.agg(
        F.lit(run.status).alias("status"), F.lit(run.cycles).cast("bigint").alias("cycles"),
        F.count(F.lit(1)).alias("clean_rows"),
        F.lit(failing[1]).cast("bigint").alias("still_out_of_range"),
        F.lit(failing[2]).cast("bigint").alias("still_unparseable"))


@query("alerts", oracle(f"""
SELECT 'CRITICAL' AS severity, 'DATA QUALITY ALERT: pipeline could not self-heal after 5 iteration(s).

Unresolved failures (1):
  - expect_column_values_to_be_between on ''quantity'' (semantic type: integer, repair confidence 82%): '
 || (SELECT count(*) FILTER (abs(quantity) > 5 AND {IS_DATE}) FROM dirty_orders) || ' rows

MANUAL INTERVENTION REQUIRED.' AS message""", "dirty_orders"))
def alerts(spark, sf):
    run = order_run(spark, sf, ALERT_RULES)
    confidence = run.history.groupBy("column_name").agg(F.max("confidence").alias("confidence"))
    return reports.alert_message(run.results, run.profiles, confidence, run.cycles)


@query("type_report", oracle(f"""
SELECT i AS ordinal, column_name, semantic_type, coalesce((
 SELECT cast(cast(round(max({CONFIDENCE}) * 100) AS int) AS varchar) || '%'
 FROM ({EXPECTED_PLAN}) p WHERE p.column_name = t.column_name), '—') AS repair_confidence
FROM (VALUES {", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TYPES))})
 t(i, column_name, semantic_type)""", "dirty_orders"))
def type_report(spark, sf):
    results, _ = order_results(spark, sf)
    types = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TYPES)],
                                  "ordinal int, column_name string, semantic_type string")
    plan = actions.plan_actions(results, types)
    return reports.type_report(types, actions.repair_confidence(plan))


@query("heal_nan", """
SELECT o_orderkey AS row_key, CASE WHEN o_orderkey % 9 = 4 THEN 'is_null in price' END AS reject_reason FROM orders""")
def heal_nan(spark, sf):
    done = heal.heal(with_nan(spark, sf), [quarantine("price", "is_null")], "row_key", AS_OF)
    kept = done.clean.select("row_key", F.lit(None).cast("string").alias("reject_reason"))
    return kept.unionByName(done.quarantined.select("row_key", "reject_reason"))


@query("heal_loop_bad_dates", """
SELECT 'PASS' AS status, count(*) FILTER (o_orderkey % 50 <> 9) AS clean_rows,
 count(*) FILTER (o_orderkey % 50 = 9) AS quarantined_rows FROM orders""")
def heal_loop_bad_dates(spark, sf):
    """Text that is no date never ends in the clean table."""
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS row_key",
        "CASE WHEN o_orderkey % 50 = 9 THEN 'garbage' ELSE cast(cast(o_orderdate AS date) AS string) END AS order_date")
    run = quality_run(df, "row_key", as_of=AS_OF)
    return run.clean.agg(F.lit(run.status).alias("status"), F.count(F.lit(1)).alias("clean_rows")).select(
        "status", "clean_rows", run.quarantined.agg(F.count(F.lit(1)).alias("q")).scalar().alias("quarantined_rows"))


@query("heal_loop_slashed_dates", """
SELECT 'PASS' AS status, count(*) FILTER (o_orderkey % 50 <> 9) AS clean_rows,
 count(*) FILTER (o_orderkey % 50 = 9) AS quarantined_rows FROM orders""")
def heal_loop_slashed_dates(spark, sf):
    """A third of the dates has the day first, which the column settles: they stay clean."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS row_key", """CASE WHEN o_orderkey % 50 = 9 THEN 'garbage'
 WHEN o_orderkey % 3 = 0 THEN date_format(cast(o_orderdate AS date), 'd/M/yyyy')
 ELSE cast(cast(o_orderdate AS date) AS string) END AS order_date""")
    run = quality_run(df, "row_key", as_of=AS_OF)
    return run.clean.agg(F.lit(run.status).alias("status"), F.count(F.lit(1)).alias("clean_rows")).select(
        "status", "clean_rows", run.quarantined.agg(F.count(F.lit(1)).alias("q")).scalar().alias("quarantined_rows"))


@query("quality_run_ambiguous_dates", """
SELECT 'clean' AS part, 'PASS' AS status, NULL AS reject_reason, count(*) AS n, true AS ambiguous
FROM orders WHERE NOT (o_orderkey % 40 = 7 OR o_orderkey % 50 = 9)
UNION ALL SELECT 'set aside', 'PASS', CASE WHEN o_orderkey % 40 = 7 AND o_orderkey % 50 <> 9
 THEN 'Ambiguous date: day and month cannot be told apart' ELSE 'Missing required value in ''order_date'' (null check failed)' END, count(*), true
FROM orders WHERE o_orderkey % 40 = 7 OR o_orderkey % 50 = 9 GROUP BY ALL""")
def quality_run_ambiguous_dates(spark, sf):
    """Some dates in a column of others have two readings: they are set aside for that reason,
    and the run's result names the column."""
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS row_key", """CASE WHEN o_orderkey % 50 = 9 THEN 'garbage'
 WHEN o_orderkey % 40 = 7 THEN '05/01/2024'
 ELSE cast(cast(o_orderdate AS date) AS string) END AS order_date""")
    run = quality_run(df, "row_key", as_of=AS_OF)
    parts = run.clean.select(F.lit("clean").alias("part"), F.lit(None).cast("string").alias("reject_reason")).unionByName(
        run.quarantined.select(F.lit("set aside").alias("part"), "reject_reason"))
    return parts.groupBy("part", "reject_reason").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.lit(run.status).alias("status"), "reject_reason", "n",
        run.date_readings.where("column_name = 'order_date'").select("ambiguous").scalar().alias("ambiguous"))


@query("heal_loop_wide_category", f"""
SELECT 'PASS' AS status, nation, count(*) AS n FROM ({WIDE}) GROUP BY nation""")
def heal_loop_wide_category(spark, sf):
    """All 25 nations survive a run whose rules come from the data."""
    run = quality_run(wide(spark, sf), "row_key", as_of=AS_OF)
    return run.clean.groupBy("nation").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(run.status).alias("status"), "nation", "n")


@query("healing_history", oracle("""
SELECT 1::BIGINT AS iteration, "column", action, detail, rows_affected, true AS success FROM (
 SELECT 'quantity' AS "column", 'fix_value' AS action, 'abs' AS detail, count(*) FILTER (quantity < 0) AS rows_affected FROM dirty_orders)
""", "dirty_orders"))
def healing_history(spark, sf):
    """Every repair of every cycle, of which one cycle repeats nothing."""
    run = order_run(spark, sf, [rule(1, "expect_column_values_to_be_between", "quantity", "0", "100")])
    return reports.healing_history(run.history).select(
        "iteration", "column", "action", "detail", "rows_affected", "success")


# Two tables of one warehouse with equal column names and different types, rules and repairs.
FLEET = {
    "web_orders": "SELECT o_orderkey AS id, o_totalprice - 1000 AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'odd' ELSE 'web' END AS status FROM {orders}",
    "refunds": "SELECT o_orderkey - o_orderkey % 2 AS id, -o_totalprice AS amount, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'paid' END AS status FROM {orders}"}
FLEET_CTES = {name: sql.format(orders="orders") for name, sql in FLEET.items()}
FLEET_RULES = [
    {"dataset": "web_orders", **rule(1, "expect_column_values_to_be_in_set", "status", values=["web"])},
    {"dataset": "web_orders", **rule(2, "expect_column_values_to_be_unique", "id")},
    {"dataset": "web_orders", **rule(3, "expect_column_values_to_be_between", "amount", "0", None)},
    {"dataset": "refunds", **rule(1, "expect_column_values_to_not_be_null", "status")},
    {"dataset": "refunds", **rule(2, "expect_column_values_to_be_unique", "id")},
    {"dataset": "refunds", **rule(3, "expect_column_values_to_be_between", "amount", None, "0")}]
FLEET_TYPES = [("web_orders", 0, "id", "identifier"), ("web_orders", 1, "amount", "currency"), ("web_orders", 2, "status", "categorical"),
               ("refunds", 0, "id", "integer"), ("refunds", 1, "amount", "float"), ("refunds", 2, "status", "categorical")]
FLEET_RESULTS = """
SELECT 'web_orders' AS dataset, 1::BIGINT AS rule_order, 'status' AS column_name, count(*) FILTER (status <> 'web') AS failing_count FROM web_orders
UNION ALL SELECT 'web_orders', 2, 'id', 0 FROM (SELECT 1)
UNION ALL SELECT 'web_orders', 3, 'amount', count(*) FILTER (amount < 0) FROM web_orders
UNION ALL SELECT 'refunds', 1, 'status', count(*) FILTER (status IS NULL) FROM refunds
UNION ALL SELECT 'refunds', 2, 'id', (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM refunds GROUP BY id) WHERE n > 1)
UNION ALL SELECT 'refunds', 3, 'amount', count(*) FILTER (amount > 0) FROM refunds"""


def fleet_results(spark, sf):
    tables = {name: spark.sql(sql, orders=table(spark, sf, "orders")) for name, sql in FLEET.items()}
    types = spark.createDataFrame(FLEET_TYPES, "dataset string, ordinal int, column_name string, semantic_type string")
    return validate.validate_fleet(tables, FLEET_RULES, AS_OF, types), types


@query("validate_fleet", oracle(FLEET_RESULTS, ctes=FLEET_CTES))
def validate_fleet(spark, sf):
    """Rules of two tables with equal column names, in one job."""
    return fleet_results(spark, sf)[0].select("dataset", "rule_order", "column_name", "failing_count")


@query("plan_actions_fleet", oracle(f"""
SELECT dataset, rule_order AS step, column_name, CASE WHEN column_name = 'status' AND dataset = 'web_orders' THEN 'fix_value'
  WHEN column_name = 'amount' THEN CASE dataset WHEN 'web_orders' THEN 'fix_value' ELSE 'quarantine' END
  WHEN column_name = 'id' THEN 'deduplicate' ELSE 'quarantine' END AS action_type,
 CASE dataset WHEN 'web_orders' THEN CASE column_name WHEN 'amount' THEN 'currency' WHEN 'id' THEN 'identifier' ELSE 'categorical' END
  ELSE CASE column_name WHEN 'amount' THEN 'float' WHEN 'id' THEN 'integer' ELSE 'categorical' END END AS semantic_type
FROM ({FLEET_RESULTS}) WHERE failing_count > 0""", ctes=FLEET_CTES))
def plan_actions_fleet(spark, sf):
    """No rule of one table meets the types of the other."""
    return actions.plan_actions(*fleet_results(spark, sf)).select(
        "dataset", "step", "column_name", "action_type", "semantic_type")


@query("type_report_fleet", oracle(f"""
SELECT dataset, i AS ordinal, c AS column_name, t AS semantic_type, CASE
  WHEN (SELECT coalesce(max(failing_count), 0) FROM ({FLEET_RESULTS}) r WHERE r.dataset = f.dataset AND r.column_name = f.c) = 0 THEN '—'
  WHEN dataset = 'web_orders' THEN CASE c WHEN 'amount' THEN '82%' WHEN 'status' THEN '70%' ELSE '95%' END
  ELSE CASE c WHEN 'status' THEN '99%' WHEN 'id' THEN '95%' ELSE '75%' END END AS repair_confidence
FROM (VALUES {", ".join(f"('{d}', {i}, '{c}', '{t}')" for d, i, c, t in FLEET_TYPES)}) f(dataset, i, c, t)""", ctes=FLEET_CTES))
def type_report_fleet(spark, sf):
    results, types = fleet_results(spark, sf)
    return reports.type_report(types, actions.repair_confidence(actions.plan_actions(results, types)))
