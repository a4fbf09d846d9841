"""Healing: repair values, split off rows, drop duplicates.

A run of row-local actions is fused. Each row's outcome depends only on which actions it
would trigger, so one grouped count of those trigger combinations is enough to replay the
whole run on the driver, including the guard against removing too much; one projection then
applies what survived. Duplicate handling needs a shuffle and ends a run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataward.constants import AMBIGUOUS_DATE, CATEGORICAL_FIXES, DATE_COLUMN_NAMES, GUARD_SHARE, MIN_DATE
from dataward.functions.coerce import (
    NUMERIC,
    NUMERIC_ORDER,
    TEMPORAL,
    col,
    date_layouts,
    looks_like_date,
    nan_to_null,
    safe_double,
    safe_timestamp,
    seen,
)
from dataward.operators.validate import (
    bound,
    fails_regex,
    not_in_set,
    now,
    outside,
    require_key,
    usable_regex,
)
from dataward.session import materialize

FUSE_LIMIT = 60              # trigger combinations are bits of one bigint
COMBINATION_LIMIT = 10_000   # more of them: the run is halved and counted again
REASON = "reject_reason"


@dataclass
class Action:
    action_type: str
    column: str
    operation: str | None = None
    condition: str | None = None
    min_bound: Any = None
    max_bound: Any = None
    valid_values: list = field(default_factory=list)
    default_value: Any = None
    regex: str | None = None
    reason: str | None = None
    semantic_type: str | None = None
    reasoning: str | None = None
    confidence: float | None = None

    @property
    def detail(self) -> str | None:
        return self.operation or self.condition


def as_actions(actions) -> list[Action]:
    """Actions from a plan table or from dicts. A plan is metadata: one row per repair."""
    rows = actions.collect() if isinstance(actions, DataFrame) else actions
    out = []
    for row in rows:
        if isinstance(row, Action):
            out.append(row)
            continue
        d = row.asDict() if isinstance(row, Row) else dict(row)
        if "column_name" in d:
            d["column"] = d["column_name"]
        d["valid_values"] = list(d.get("valid_values") or [])
        out.append(Action(**{k: v for k, v in d.items() if k in Action.__dataclass_fields__}))
    return out


@dataclass
class Healed:
    clean: DataFrame
    quarantined: DataFrame | None
    stats: list[dict]          # one per action: success, rows_affected, remaining_rows


def _condition(action: Action) -> str | None:
    alias = {"not_matches_regex": "fails_regex"}
    return alias.get(action.condition, action.condition)


class _Steps:
    """A table that grows helper columns, each computed once per row however often later
    ones refer to it."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.count = 0

    def add(self, value: Column) -> Column:
        name = f"__step{self.count}"
        self.count += 1
        self.df = self.df.withColumn(name, value)
        return F.col(name)


def _quarantine_mask(steps: _Steps, action: Action, value: Column, data_type: T.DataType,
                     as_of: str | None, layout: str | None) -> Column:
    """True for rows the action would set aside (duplicates are handled elsewhere)."""
    condition = _condition(action)

    def not_a_number() -> Column:
        return value.isNotNull() & safe_double(value, data_type).isNull()

    if condition == "is_null":
        return seen(value, action.column, data_type, layout).isNull()
    if condition == "is_future_date":
        name = action.column.lower()
        is_date = (action.semantic_type in ("datetime", "date")
                   or any(w in name for w in DATE_COLUMN_NAMES)
                   or isinstance(data_type, TEMPORAL))
        if not is_date:
            return not_a_number()
        moment = steps.add(safe_timestamp(value, data_type, layout))
        return ~F.coalesce(moment.between(F.lit(MIN_DATE).cast("timestamp"), now(as_of)),
                           F.lit(False))
    if condition == "out_of_bounds":
        if action.min_bound is None and action.max_bound is None:
            return not_a_number()
        return outside(steps.add(safe_double(value, data_type)), bound(action.min_bound),
                       bound(action.max_bound))
    if condition == "fails_regex" and action.regex and usable_regex(
            steps.df.sparkSession, action.regex):
        return fails_regex(value, action.regex)
    return F.lit(False)


def _fix(steps: _Steps, action: Action, value: Column,
         data_type: T.DataType) -> tuple[Column, Column]:
    """(rows the fix counts as changed, the value after it)."""
    unchanged = F.lit(False), value
    if action.operation == "abs":
        number = steps.add(safe_double(value, data_type))
        mask = steps.add(F.coalesce(number < 0, F.lit(False)))
        positive = F.abs(value) if isinstance(data_type, NUMERIC) else F.abs(number)
        fixed = positive.cast(data_type)
    elif action.operation in CATEGORICAL_FIXES:
        if not action.valid_values or action.default_value is None:
            return unchanged
        mask = steps.add(not_in_set(value, data_type, action.valid_values))
        fixed = F.lit(action.default_value).cast(data_type)
    elif action.operation == "replace_empty_string" and isinstance(data_type, T.StringType):
        mask = steps.add(F.coalesce(value == "", F.lit(False)))
        if action.default_value is None:
            return mask, value
        fixed = F.lit(str(action.default_value))
    else:
        return unchanged
    return mask, steps.add(F.when(mask, fixed).otherwise(value))


def _reads_dates(action: Action) -> bool:
    return _condition(action) in ("is_null", "is_future_date")


def _reason(action: Action, value: Column | None, data_type: T.DataType | None, layout: str | None) -> Column:
    """Why the action sets a row aside."""
    given = F.lit(action.reason or "Data quality failure")
    if (value is None or layout or not _reads_dates(action) or not looks_like_date(action.column)
            or not isinstance(data_type, T.StringType)):
        return given
    return F.when(value.rlike(NUMERIC_ORDER), F.lit(AMBIGUOUS_DATE)).otherwise(given)


def is_shuffle(action: Action) -> bool:
    """Whether the action handles duplicates."""
    return action.action_type == "deduplicate" or (
        action.action_type == "quarantine" and _condition(action) == "is_duplicate")


def heal(df: DataFrame, actions, key: str, as_of: str | None = None,
         guard: float = GUARD_SHARE, cut_lineage: bool | None = None,
         layouts: dict[str, str] | None = None, key_checked: bool = False) -> Healed:
    """Apply actions in order. ``key`` is a unique, non-null column that also defines
    which of several duplicates is the first; that it is one is checked here unless the
    caller has done so (``key_checked``). ``layouts`` of numeric dates, by column, are
    found in the table if not given. Rows whose date is set aside because its day and month
    cannot be told apart say so as their reason.

    ``cut_lineage`` writes each intermediate table once, so that long plans neither
    recompute nor lose it; by default this is done when a plan has several stages."""
    plan, df = as_actions(actions), nan_to_null(df)
    if layouts is None:
        layouts = date_layouts(df, [a.column for a in plan if a.action_type == "quarantine" and _reads_dates(a)])
    if not key_checked and any(is_shuffle(a) for a in plan):
        require_key(df, key)
    if cut_lineage is None:
        cut_lineage = len(plan) > 1 and any(is_shuffle(a) for a in plan)
    clean, rejected, stats = df, [], []
    position = 0
    while position < len(plan):
        if is_shuffle(plan[position]):
            clean, gone, row = _duplicates(clean, plan[position], key, guard, cut_lineage)
            stats.append(row)
            position += 1
        else:
            end = position
            while (end < len(plan) and end - position < FUSE_LIMIT
                   and not is_shuffle(plan[end])):
                end += 1
            clean, gone, rows = _fused(clean, plan[position:end], as_of, guard, cut_lineage, layouts)
            stats += rows
            position += len(rows)
        if gone is not None:
            rejected.append(gone)
    out = None
    for part in rejected:
        out = part if out is None else out.unionByName(part)
    return Healed(clean, out, stats)


def _fused(df: DataFrame, run: list[Action], as_of, guard, cut_lineage, layouts):
    """Apply a run of row-local actions, or its first half when rows combine too many
    triggers: (clean rows, set-aside rows or None, one result per action done)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    steps = _Steps(df)
    current = {c: col(c) for c in df.columns}
    masks: list[Column] = []
    reasons: list[Column] = []
    fixes: list[tuple[int, str, Column]] = []
    for i, action in enumerate(run):
        mask = F.lit(False)
        reasons.append(_reason(action, current.get(action.column), types.get(action.column),
                               layouts.get(action.column)))
        if action.column in types:
            value, data_type = current[action.column], types[action.column]
            if action.action_type == "fix_value":
                mask, fixed = _fix(steps, action, value, data_type)
                current[action.column] = fixed
                fixes.append((i, action.column, fixed))
            elif action.action_type == "quarantine":
                mask = steps.add(F.coalesce(
                    _quarantine_mask(steps, action, value, data_type, as_of,
                                     layouts.get(action.column)), F.lit(False)))
        masks.append(mask)

    bits = F.lit(0).cast("bigint")
    for i, mask in enumerate(masks):
        bits = bits + F.when(mask, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    groups = (steps.df.select(bits.alias("bits")).groupBy("bits")
              .agg(F.count(F.lit(1)).alias("n"))
              .limit(COMBINATION_LIMIT + 1).collect())
    if len(groups) > COMBINATION_LIMIT:
        return _fused(df, run[:len(run) // 2], as_of, guard, cut_lineage, layouts)
    rows, effective = _replay(run, types, {g.bits: g.n for g in groups}, guard)
    return (*_apply(df, steps, masks, reasons, fixes, effective, cut_lineage), rows)


def _replay(run, types, alive: dict[int, int], guard: float) -> tuple[list[dict], list[int]]:
    """Results of the actions in order, from the counts of trigger combinations, and the
    positions of the quarantines that take place."""
    rows, effective = [], []
    for i, action in enumerate(run):
        total = sum(alive.values())
        if action.column not in types:
            rows.append(_stat(action, False, 0, total,
                              f"Column '{action.column}' not found"))
            continue
        hit = sum(n for b, n in alive.items() if b >> i & 1)
        if action.action_type == "quarantine":
            if total > 0 and hit > total * guard:
                hit = 0
            elif hit:
                effective.append(i)
                alive = {b: n for b, n in alive.items() if not b >> i & 1}
        rows.append(_stat(action, True, hit, sum(alive.values())))
    return rows, effective


def _apply(df, steps, masks, reasons, fixes, effective, cut_lineage):
    """Project the surviving effects: (clean rows, set-aside rows or None)."""
    values = {c: col(c) for c in df.columns}
    if not effective:
        values |= {column: fixed for _, column, fixed in fixes}
        clean = steps.df.select([values[c].alias(c) for c in df.columns])
        return (materialize(clean, "healed") if cut_lineage and fixes else clean), None
    rejected_by = steps.add(F.coalesce(
        *[F.when(masks[i], F.lit(i)) for i in effective], F.lit(len(masks))))
    for i, column, fixed in fixes:
        # a row set aside earlier keeps the value it had then
        values[column] = fixed if effective[0] > i else (
            F.when(rejected_by > i, fixed).otherwise(values[column]))
    reason = F.coalesce(*[F.when(rejected_by == i, reasons[i]) for i in effective])
    out = steps.df.select([values[c].alias(c) for c in df.columns] + [reason.alias(REASON)])
    if cut_lineage:
        out = materialize(out, "healed")
    return (out.where(F.col(REASON).isNull()).drop(REASON),
            out.where(F.col(REASON).isNotNull()))


def first_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """The first row of each value in key order, nulls being one value. The rank filter
    runs before the shuffle too: a hot value leaves each task as one row."""
    w = Window.partitionBy(col(column)).orderBy(col(key))
    return (df.withColumn("__place", F.row_number().over(w))
            .where(F.col("__place") == 1).drop("__place"))


def later_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """All rows but the first of each value: an anti-join on the unique key, so rows of a
    hot value spread evenly."""
    firsts = df.groupBy(col(column)).agg(F.min(col(key)).alias(key)).select(col(key))
    return df.join(firsts, key, "left_anti")


def _duplicates(df: DataFrame, action: Action, key: str, guard: float, cut_lineage: bool):
    """Keep first occurrences. Quarantine also returns the others."""
    if action.column not in df.columns:
        return df, None, _stat(action, False, 0, df.count(),
                               f"Column '{action.column}' not found")
    groups = df.groupBy(col(action.column)).agg(F.count(F.lit(1)).alias("n"))
    size = groups.agg(F.count(F.lit(1)).alias("kept"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    hit = size.total - size.kept
    quarantine = action.action_type == "quarantine"
    if hit == 0 or (quarantine and hit > size.total * guard):
        return df, None, _stat(action, True, 0, size.total)
    clean = first_rows(df, action.column, key)
    if cut_lineage:
        clean = materialize(clean, "deduplicated")
    gone = None
    if quarantine:
        gone = later_rows(df, action.column, key).withColumn(
            REASON, F.lit(action.reason or "Data quality failure"))
        if cut_lineage:
            gone = materialize(gone, "duplicates")
    return clean, gone, _stat(action, True, hit, size.kept)


def _stat(action: Action, success: bool, affected: int, remaining: int,
          error: str | None = None) -> dict:
    return {"column": action.column, "action_type": action.action_type,
            "operation_or_condition": action.detail, "success": success,
            "rows_affected": affected, "remaining_rows": remaining, "error": error,
            "reasoning": action.reasoning or action.reason, "confidence": action.confidence}
