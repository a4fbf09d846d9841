"""From failed rules to repair actions: joins of small metadata tables.

An action row is (column_name, failure_type, action_type, operation, condition, min_bound,
max_bound, valid_values, default_value, regex, reason, reasoning, semantic_type). Tables of a
fleet are told apart by a ``dataset`` column: where both sides of a join have one, it is part
of the key, and rows of a plan keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataward.constants import (
    ACTION_TYPES,
    BETWEEN,
    CATEGORICAL_FIXES,
    DEFAULT_CONFIDENCE,
    FIX_OPERATIONS,
    IN_SET,
    NOT_NULL,
    REGEX,
    REPAIR_CONFIDENCE,
    UNIQUE,
)
from dataward.functions.names import ABS_IS_SAFE
from dataward.operators.rules import canonical_type

ACTION_FIELDS = {
    "action_type": "string", "operation": "string", "condition": "string",
    "min_bound": "string", "max_bound": "string", "valid_values": "array<string>",
    "default_value": "string", "regex": "string", "reason": "string", "reasoning": "string",
}
PROPOSAL_SCHEMA = ("proposal_order bigint, column_name string, failure_type string, "
                   + ", ".join(f"{n} {t}" for n, t in ACTION_FIELDS.items()))
HISTORY_SCHEMA = (
    "iteration bigint, column_name string, action_type string, "
    "operation_or_condition string, rows_affected bigint, success boolean, "
    "confidence double, error string")


DATED = ("(semantic_type = 'datetime' OR lower(column_name) LIKE '%date%' "
         "OR lower(column_name) LIKE '%time%')")


def _action(**given: str) -> str:
    """SQL for an action struct; the values given are SQL, all others are null."""
    return "struct(" + ", ".join(
        f"cast({given.get(n, 'NULL')} AS {t}) AS {n}" for n, t in ACTION_FIELDS.items()) + ")"


def _about(before: str, after: str) -> str:
    return f"concat('{before} \\'', column_name, '\\'{after}')"


def action_for_failure() -> Column:
    """The repair for a failed rule, as a struct, from the rule and the semantic type."""
    why = ("concat('Deterministic repair for ', expectation_type, ' on \\'', column_name, "
           "'\\'')")
    null = {"action_type": "'quarantine'", "condition": "'is_null'", "reasoning": why}
    bounds = ("concat('\\'', column_name, '\\' values outside expected range [', "
              "coalesce(min_value, 'None'), ', ', coalesce(max_value, 'None'), ']')")
    default = "try_element_at(value_set, 1)"
    branches = [
        (f"expectation_type = '{NOT_NULL}'", _action(
            **null, reason=_about("Missing required value in", " (null check failed)"))),
        (f"expectation_type = '{BETWEEN}' AND {DATED}", _action(
            action_type="'quarantine'", condition="'is_future_date'", reasoning=why,
            reason=_about("Invalid date in", " (out of valid range)"))),
        (f"expectation_type = '{BETWEEN}' AND {ABS_IS_SAFE}", _action(
            action_type="'fix_value'", operation="'abs'", reasoning=why,
            reason=_about("Negative values are errors in", " — taking the absolute value"))),
        (f"expectation_type = '{BETWEEN}'", _action(
            action_type="'quarantine'", condition="'out_of_bounds'", min_bound="min_value",
            max_bound="max_value", reasoning=why, reason=bounds)),
        (f"expectation_type = '{UNIQUE}'", _action(
            action_type="'deduplicate'", reasoning=why)),
        (f"expectation_type = '{IN_SET}' AND size(value_set) > 0", _action(
            action_type="'fix_value'", operation="'replace_invalid_categorical'",
            valid_values="value_set", default_value=default, reasoning=why,
            reason=f"concat({_about('Invalid categorical value in', ' — replacing with ')}, "
                   f"'\\'', {default}, '\\'')")),
        (f"expectation_type = '{IN_SET}'", _action(
            **null, reason=_about("Invalid categorical value in",
                                  " — no value set, quarantining"))),
        (f"expectation_type = '{REGEX}'", _action(
            action_type="'quarantine'", condition="'fails_regex'", regex="regex",
            reasoning=why,
            reason=_about("Value in", " failed regex validation — quarantining"))),
    ]
    other = _action(**null, reason="concat('Unhandled failure type \\'', expectation_type, "
                                   + _about("\\' on", " — quarantining") + ")")
    return F.expr("CASE " + " ".join(f"WHEN {test} THEN {action}" for test, action in branches)
                  + f" ELSE {other} END")


DATASET = "dataset"


def column_key(*tables: DataFrame) -> list[str]:
    """What names a column in all of the tables."""
    return [DATASET, "column_name"] if all(DATASET in t.columns for t in tables) else ["column_name"]


def _dataset(table: DataFrame) -> list[str]:
    return [DATASET] if DATASET in table.columns else []


def _failures(results: DataFrame, semantics: DataFrame) -> DataFrame:
    """Failed rules with canonical type and semantic type."""
    key = column_key(results, semantics)
    return (results.where(~F.col("success"))
            .withColumn("expectation_type", canonical_type(F.col("expectation_type")))
            .join(semantics.select(*key, "semantic_type"), key, "left")
            .withColumn("semantic_type", F.coalesce("semantic_type", F.lit("unknown"))))


def plan_actions(results: DataFrame, semantics: DataFrame,
                 proposed: DataFrame | None = None) -> DataFrame:
    """Screened and completed proposals, then the standard repair of every failed rule
    that no proposal covers. ``semantics`` is (column_name, semantic_type)."""
    failures = _failures(results, semantics).withColumn("standard", action_for_failure())
    own = _dataset(failures)
    if proposed is None:
        plan = failures.select(
            *own, F.col("rule_order").alias("step"), "column_name",
            F.col("expectation_type").alias("failure_type"), "semantic_type",
            "min_value", "max_value", "value_set", F.col("standard").alias("act"))
        return _complete(plan)
    screened = _screen(proposed, failures, semantics)
    covered = screened.where(F.col("rule_order").isNotNull()).select(*own, "rule_order")
    rest = failures.join(covered, [*own, "rule_order"], "left_anti").select(
        *own, (F.lit(1_000_000) + F.col("rule_order")).alias("step"), "column_name",
        F.col("expectation_type").alias("failure_type"), "semantic_type",
        "min_value", "max_value", "value_set", F.col("standard").alias("act"))
    return _complete(screened.drop("rule_order").unionByName(rest))


def _screen(proposed: DataFrame, failures: DataFrame, semantics: DataFrame) -> DataFrame:
    """Match each proposal to its failed rule and replace what is not on the menu."""
    own = proposed.where(F.col("column_name").isNotNull()).withColumn(
        "failure_type", canonical_type(F.col("failure_type")))
    key = column_key(failures, own)
    if key == ["column_name"] and DATASET in failures.columns:
        raise ValueError("proposals for a fleet need a dataset column")
    rule = failures.select(
        *[F.col(k).alias(f"of_{k}") for k in key], "rule_order", "expectation_type", "min_value",
        "max_value", "value_set", "standard")
    on = own.failure_type.isNull() | (own.failure_type == rule.expectation_type)
    for k in key:
        on = on & (own[k] == rule[f"of_{k}"])
    matched = own.join(rule, on, "left")
    w = Window.partitionBy(*_dataset(own), "proposal_order").orderBy(F.desc("rule_order"))
    key = column_key(own, semantics)
    matched = (matched.withColumn("place", F.row_number().over(w)).where(F.col("place") == 1)
               .join(semantics.select(*key, "semantic_type"), key, "left")
               .withColumn("semantic_type", F.coalesce("semantic_type", F.lit("unknown"))))
    kind, operation = F.col("action_type"), F.col("operation")
    rejected = (
        ~F.coalesce(kind.isin(ACTION_TYPES), F.lit(False))
        | ((kind == "fix_value") & ~F.coalesce(operation.isin(FIX_OPERATIONS), F.lit(False)))
        | ((kind == "fix_value") & operation.isin(CATEGORICAL_FIXES)
           & (F.col("expectation_type") != IN_SET))
        | ((kind == "quarantine") & F.col("expectation_type").isin(REGEX, BETWEEN)))
    as_proposed = F.expr(_action(**{n: n for n in ACTION_FIELDS}))
    return matched.select(
        *_dataset(failures), F.col("proposal_order").alias("step"), "column_name",
        F.coalesce("failure_type", "expectation_type").alias("failure_type"), "rule_order",
        "semantic_type", "min_value", "max_value", "value_set",
        F.when(F.coalesce(rejected, F.lit(False)) & F.col("rule_order").isNotNull(),
               F.col("standard")).otherwise(as_proposed).alias("act"))


def _complete(plan: DataFrame) -> DataFrame:
    """Fill what an action lacks from its failed rule, and veto unsafe repairs."""
    own = _dataset(plan)
    facts = plan.selectExpr(
        *own, "step", "column_name", "failure_type", "semantic_type", "min_value", "max_value",
        "value_set AS rule_set", "act.*").selectExpr(
        "*",
        f"coalesce(operation IN ({_words(CATEGORICAL_FIXES)}), false) AS categorical",
        "coalesce(size(rule_set), 0) > 0 AS rule_has_set",
        f"coalesce(operation = 'abs', false) AND NOT {ABS_IS_SAFE} AS veto").selectExpr(
        "*", "categorical AND NOT rule_has_set AND coalesce(size(valid_values), 0) <= 0 "
             "AS no_set").selectExpr(
        "*", """CASE WHEN no_set THEN 'is_null' WHEN veto THEN 'out_of_bounds'
            WHEN action_type <> 'quarantine' OR condition IS NOT NULL THEN condition
            WHEN semantic_type = 'datetime' OR lower(column_name) LIKE '%date%'
                THEN 'is_future_date'
            WHEN failure_type LIKE '%null%' THEN 'is_null'
            WHEN failure_type LIKE '%unique%' THEN 'is_duplicate'
            WHEN failure_type LIKE '%between%' THEN 'out_of_bounds'
            ELSE 'is_null' END AS final_condition""")

    def bound(own: str, rule: str) -> str:
        return (f"CASE WHEN veto THEN {rule} WHEN final_condition = 'out_of_bounds' "
                f"THEN coalesce({own}, {rule}) ELSE {own} END AS {own}")

    return facts.selectExpr(
        *own, "step", "column_name", "failure_type", "semantic_type", "action_type AS planned_type",
        "CASE WHEN no_set OR veto THEN 'quarantine' ELSE action_type END AS action_type",
        "CASE WHEN NOT (no_set OR veto) THEN operation END AS operation",
        "final_condition AS condition",
        bound("min_bound", "min_value"), bound("max_bound", "max_value"),
        "CASE WHEN categorical AND rule_has_set THEN rule_set ELSE valid_values END "
        "AS valid_values",
        "CASE WHEN NOT (categorical AND rule_has_set) THEN default_value "
        "WHEN array_contains(rule_set, default_value) THEN default_value "
        "ELSE rule_set[0] END AS default_value",
        "regex",
        f"""CASE WHEN no_set THEN 'No valid categorical set available — quarantining'
            WHEN veto THEN {_about('Signed numeric', ' — quarantining out-of-range values')}
            WHEN action_type = 'quarantine' AND reason IS NULL
                THEN coalesce(reasoning, 'Data quality failure')
            ELSE reason END AS reason""",
        "coalesce(reasoning, '') AS reasoning")


def _words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def confidence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REPAIR_CONFIDENCE,
                                 "action_type string, detail string, confidence double")


def with_confidence(actions: DataFrame) -> DataFrame:
    """Add the fixed confidence of each action; unlisted ones get the default."""
    lookup = confidence_table(actions.sparkSession).withColumnRenamed("action_type", "t")
    joined = actions.withColumn("detail", F.coalesce("operation", "condition")).alias("a").join(
        F.broadcast(lookup.alias("l")),
        (F.col("a.action_type") == F.col("l.t"))
        & F.col("a.detail").eqNullSafe(F.col("l.detail")), "left")
    return joined.select("a.*", F.coalesce("l.confidence", F.lit(DEFAULT_CONFIDENCE))
                         .alias("confidence"))


def repair_confidence(actions: DataFrame) -> DataFrame:
    """Highest confidence per column."""
    return with_confidence(actions).groupBy(*column_key(actions)).agg(
        F.max("confidence").alias("confidence"))


def skip_tried(plan: DataFrame, history: DataFrame) -> DataFrame:
    """Leave out (column, action type) pairs that once changed nothing."""
    key = column_key(plan, history)
    tried = (history.where(F.coalesce("rows_affected", F.lit(0)) == 0)
             .select(*key, F.col("action_type").alias("planned_type")).distinct())
    return plan.join(tried, [*key, "planned_type"], "left_anti")
