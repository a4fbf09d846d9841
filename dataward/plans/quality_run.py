"""The quality run: profile, build rules, then validate and heal until clean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from dataward.constants import GUARD_SHARE, MAX_CYCLES
from dataward.functions.coerce import READINGS, date_readings
from dataward.operators.actions import plan_actions, skip_tried, with_confidence
from dataward.operators.classify import settled, with_semantic_types
from dataward.operators.heal import as_actions, heal, is_shuffle
from dataward.operators.profile import profile
from dataward.operators.rules import build_suite
from dataward.operators.validate import RESULT_SCHEMA, as_rules, validate

RUN_HISTORY = (
    "iteration bigint, column_name string, action_type string, "
    "operation_or_condition string, rows_affected bigint, remaining_rows bigint, "
    "success boolean, confidence double, reasoning string, error string")


@dataclass
class QualityRun:
    status: str                      # PASS or ALERT
    cycles: int
    clean: DataFrame
    quarantined: DataFrame | None
    profiles: DataFrame
    rules: list
    results: DataFrame               # the last validation
    history: DataFrame
    date_readings: DataFrame         # how text dates were read, and which have two readings


def quality_run(df: DataFrame, key: str, dataset: str = "dataset", as_of: str | None = None,
                rules=None, proposed_rules: DataFrame | None = None,
                proposed_actions: DataFrame | None = None, max_cycles: int = MAX_CYCLES,
                guard: float = GUARD_SHARE, typed: DataFrame | None = None) -> QualityRun:
    """Heal ``df`` against its suite for at most ``max_cycles`` rounds.

    ``rules`` replaces the generated suite, ``typed`` the profile with semantic types;
    ``proposed_rules`` and ``proposed_actions`` are
    screened first. Only suite-sized results reach the driver: one validation row per rule
    and the counts that decide the guard. Each round's table is written once to shared
    storage, so rounds neither recompute earlier ones nor depend on executors staying up."""
    spark = df.sparkSession
    readings = date_readings(df).collect()       # one row per text column named like a date
    layouts = {r.column_name: r.layout for r in readings if r.layout}
    if typed is None:
        typed = with_semantic_types(profile(df, dataset, as_of, layouts=layouts))
    typed = settled(typed)
    semantics = {r.column_name: r.semantic_type for r in typed.collect()}
    suite = as_rules(build_suite(typed, proposed_rules) if rules is None else rules)

    work, gone, history = df, None, []
    cycle, key_checked = 0, False
    while True:
        result_rows = validate(work, suite, as_of, semantics, skip_empty=True, layouts=layouts).collect()
        results = spark.createDataFrame(result_rows, RESULT_SCHEMA)
        if all(r.success for r in result_rows):
            status = "PASS"
            break
        if cycle == max_cycles:
            status = "ALERT"
            break
        cycle += 1
        past = spark.createDataFrame(history, RUN_HISTORY)
        plan = with_confidence(
            skip_tried(plan_actions(results, typed, proposed_actions), past))
        actions = as_actions(sorted(plan.collect(), key=lambda a: a.step))
        if not actions:
            cycle, status = max_cycles, "ALERT"      # nothing left to try in any round
            break
        done = heal(work, actions, key, as_of, guard, cut_lineage=True, layouts=layouts, key_checked=key_checked)
        # rows that stay keep their keys, unless a repair changes them
        key_checked = ((key_checked or any(is_shuffle(a) for a in actions))
                       and not any(a.action_type == "fix_value" and a.column == key for a in actions))
        work = done.clean
        if done.quarantined is not None:
            gone = done.quarantined if gone is None else gone.unionByName(done.quarantined)
        history += [(cycle, s["column"], s["action_type"], s["operation_or_condition"],
                     s["rows_affected"], s["remaining_rows"], s["success"], s["confidence"],
                     s["reasoning"], s["error"]) for s in done.stats]
    return QualityRun(status, cycle, work, gone, typed, suite, results,
                      spark.createDataFrame(history, RUN_HISTORY),
                      spark.createDataFrame(readings, READINGS))
