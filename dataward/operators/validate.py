"""Validation: all row-local rules in one scan, all uniqueness rules in one more, and one for
the rules whose value sets are too large to be written into a plan.

Values are read as the profile reads them: NaN is null, and so is text that is no date in
a text column named like a date."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from fractions import Fraction
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataward.constants import (
    BETWEEN,
    DATEUTIL,
    FAILING_KEYS,
    IN_SET,
    NOT_NULL,
    OF_TYPE,
    REGEX,
    RULE_TYPES,
    UNIQUE,
)
from dataward.functions.coerce import (
    INTEGRAL,
    NUMERIC,
    TEMPORAL,
    col,
    date_layouts,
    nan_to_null,
    safe_double,
    safe_timestamp,
    seen,
)

LONG_VALUE = 256          # longer texts are grouped by digest
SET_LITERALS = 1000       # values of a set that are written into the plan; larger sets are tables

RESULT_SCHEMA = (
    "rule_order bigint, expectation_type string, column_name string, min_value string, "
    "max_value string, value_set array<string>, regex string, type_ string, "
    "reasoning string, failing_count bigint, success boolean, error string")


@dataclass(frozen=True)
class Rule:
    rule_order: int
    expectation_type: str
    column_name: str
    min_value: Any = None
    max_value: Any = None
    value_set: list = field(default_factory=list)
    regex: str | None = None
    type_: str | None = None
    reasoning: str = ""


def as_rules(rules) -> list[Rule]:
    """Rules from a rule table or from dicts. A suite is metadata: one row per rule."""
    rows = rules.collect() if isinstance(rules, DataFrame) else rules
    out = []
    for i, row in enumerate(rows):
        if isinstance(row, Rule):
            out.append(row)
            continue
        d = row.asDict() if isinstance(row, Row) else dict(row)
        d.setdefault("rule_order", i)
        d["value_set"] = list(d.get("value_set") or [])
        out.append(Rule(**{k: v for k, v in d.items() if k in Rule.__dataclass_fields__}))
    return sorted(out, key=lambda r: r.rule_order)


def usable_regex(spark: SparkSession, pattern: str | None) -> bool:
    """Whether the pattern compiles; a bad one must not fail the whole job."""
    try:
        re.compile(pattern or "")
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(anchored(pattern))
        return True
    except Exception:
        return False


def anchored(pattern: str | None) -> str:
    """The pattern as Spark's engine writes it: other names for named groups and the end."""
    text = pattern or ""
    for name in set(re.findall(r"\(\?P[<=](\w+)[>)]", text)):
        plain = re.sub(r"\W|_", "", f"g{name}")
        text = text.replace(f"(?P<{name}>", f"(?<{plain}>").replace(f"(?P={name})", f"\\k<{plain}>")
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", text)
    return rf"(?U)\A(?:{text})"


def fails_regex(value: Column, pattern: str) -> Column:
    """Non-null and not matching from the start of the text."""
    return value.isNotNull() & ~value.cast("string").rlike(anchored(pattern))


def not_in_set(value: Column, data_type: T.DataType, allowed: list) -> Column:
    """Non-null and outside the set. Numbers are compared as numbers of the column's type."""
    kind, members = set_members(data_type, allowed)
    literals = [F.lit(m).cast(kind) for m in members]
    return value.isNotNull() & ~value.cast(kind).isin(literals)


def set_members(data_type: T.DataType, allowed: list) -> tuple[str, list]:
    """The type in which a column is compared with a set, and the set's members of that type.
    A number that the type cannot hold is no member."""
    if not isinstance(data_type, NUMERIC):
        return "string", sorted({str(a) for a in allowed})
    numbers = {n for n in map(_decimal, allowed) if n is not None}
    if isinstance(data_type, INTEGRAL):
        return "bigint", sorted({int(n) for n in numbers if n == n.to_integral_value() and -2**63 <= n < 2**63})
    if isinstance(data_type, T.DecimalType):
        top, unit = 10 ** data_type.precision, 10 ** data_type.scale
        return data_type.simpleString(), sorted(
            {n for n in numbers if (Fraction(n) * unit).denominator == 1 and abs(Fraction(n) * unit) < top})
    return "double", sorted({float(n) for n in numbers})


def _decimal(value) -> Decimal | None:
    """An exact number; null for what is none."""
    try:
        number = Decimal(str(value).strip())
        return number if number.is_finite() else None
    except InvalidOperation:
        return None


def bound(value) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def outside(value: Column, low, high) -> Column:
    tests = []
    if low is not None:
        tests.append(value < F.lit(low))
    if high is not None:
        tests.append(value > F.lit(high))
    return _any(tests)


def is_date_rule(rule: Rule, data_type: T.DataType, semantic_type: str | None) -> bool:
    return (isinstance(data_type, TEMPORAL) or "date" in rule.column_name.lower()
            or semantic_type == "datetime")


def now(as_of: str | None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def _date_bound(value, as_of: str | None) -> Column | None:
    if value is None:
        return None
    if value == "today":
        return now(as_of)
    return safe_timestamp(F.lit(str(value)), T.StringType())


def fail_mask(spark: SparkSession, rule: Rule, data_type: T.DataType,
              as_of: str | None = None, semantic_type: str | None = None,
              layout: str | None = None) -> Column | None:
    """True where a row breaks the rule; None for rules that are not row-local."""
    c, kind = col(rule.column_name), rule.expectation_type
    if kind == NOT_NULL:
        return seen(c, rule.column_name, data_type, layout).isNull()
    if kind == BETWEEN:
        if is_date_rule(rule, data_type, semantic_type):
            moment = safe_timestamp(c, data_type, layout)
            low, high = _date_bound(rule.min_value, as_of), _date_bound(rule.max_value, as_of)
            return outside(moment, low, high)
        return outside(safe_double(c, data_type), bound(rule.min_value),
                       bound(rule.max_value))
    if kind == IN_SET:
        return not_in_set(c, data_type, rule.value_set)
    if kind == REGEX:
        return fails_regex(c, rule.regex or "")
    if kind == OF_TYPE:
        if rule.type_ in ("int", "float", "number"):
            return safe_double(c, data_type).isNull()
        return F.lit(False)
    if kind == DATEUTIL:
        return c.isNotNull() & safe_timestamp(c, data_type, layout).isNull()
    return None


@dataclass
class Checks:
    """A suite sorted by how each rule is answered for one table."""

    local: list[tuple[Rule, Column]]
    unique: list[Rule]
    sets: list[Rule]                         # sets of more than SET_LITERALS values
    fixed: list[tuple[Rule, bool, str]]      # missing column or unknown type


def plan_checks(df: DataFrame, rules: list[Rule], as_of: str | None,
                semantic_types: dict[str, str] | None, layouts: dict[str, str]) -> Checks:
    types = {f.name: f.dataType for f in df.schema.fields}
    checks = Checks([], [], [], [])
    for rule in rules:
        if rule.column_name not in types:
            checks.fixed.append(
                (rule, True, f"Column '{rule.column_name}' not found in dataset — skipped"))
        elif rule.expectation_type not in RULE_TYPES:
            checks.fixed.append(
                (rule, False, f"Unknown expectation type: {rule.expectation_type}"))
        elif rule.expectation_type == UNIQUE:
            checks.unique.append(rule)
        elif rule.expectation_type == IN_SET and len(rule.value_set) > SET_LITERALS:
            checks.sets.append(rule)
        elif rule.expectation_type == REGEX and not usable_regex(df.sparkSession, rule.regex):
            checks.fixed.append((rule, True, f"Pattern cannot be used: {rule.regex} — skipped"))
        else:
            checks.local.append((rule, fail_mask(
                df.sparkSession, rule, types[rule.column_name], as_of,
                (semantic_types or {}).get(rule.column_name), layouts.get(rule.column_name))))
    return checks


def _counted(df: DataFrame, checks: Checks, layouts: dict[str, str]) -> DataFrame | None:
    """(rule_order, failing_count, filled) of every rule that needs the data; ``filled``
    counts the non-null values of the rule's column."""
    parts = []
    if checks.local:
        triples = [F.struct(F.lit(r.rule_order).cast("bigint").alias("rule_order"),
                            F.count_if(mask).alias("failing_count"),
                            F.count(_seen(df, r, layouts)).alias("filled"))
                   for r, mask in checks.local]
        parts.append(df.agg(F.array(*triples).alias("p")).select(F.inline("p")))
    if checks.unique:
        # one scan and one shuffle for all uniqueness rules; nulls are one value
        pairs, keys = _keyed(df, checks.unique, layouts)
        groups = pairs.groupBy("rule_order", *keys).agg(F.count(F.lit(1)).alias("n"))
        given = _any([F.col(k).isNotNull() for k in keys])
        parts.append(groups.groupBy("rule_order").agg(
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
            .alias("failing_count"),
            F.coalesce(F.sum(F.when(given, F.col("n"))), F.lit(0))
            .alias("filled")))
    if checks.sets:
        # values are counted first, so a hot one meets its set once per task
        pairs, members, keys = _sets(df, checks.sets)
        groups = pairs.groupBy("rule_order", *keys).agg(F.count(F.lit(1)).alias("n"))
        filled = groups.groupBy("rule_order").agg(F.sum("n").alias("filled"))
        failing = _outside(groups, members, keys).groupBy("rule_order").agg(F.sum("n").alias("failing_count"))
        parts.append(filled.join(failing, "rule_order", "left").select(
            "rule_order", F.coalesce("failing_count", F.lit(0)).alias("failing_count"), "filled"))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _seen(df: DataFrame, rule: Rule, layouts: dict[str, str]) -> Column:
    return seen(col(rule.column_name), rule.column_name, df.schema[rule.column_name].dataType,
                layouts.get(rule.column_name))


def _comparable(value: Column, data_type: T.DataType) -> tuple[Column, str]:
    """A value that groups as its own type does, and that type: 0.0 and -0.0 are one, so are
    NaNs, and arrays are compared item by item. Long texts go by their digest, marked as such;
    maps by their sorted entries."""
    if isinstance(data_type, T.StringType):
        long = F.length(value) > LONG_VALUE
        key = F.struct(long.alias("long"), F.when(long, F.sha2(value, 256)).otherwise(value).alias("key"))
        return F.when(value.isNotNull(), key), "struct<long:boolean,key:string>"
    if isinstance(data_type, T.MapType):
        entries = f"array<struct<key:{data_type.keyType.simpleString()},value:{data_type.valueType.simpleString()}>>"
        return F.sort_array(F.map_entries(value)), entries
    return value, data_type.simpleString()


def _stacked(df: DataFrame, items: list[tuple[Rule, Column, str]], *extra: Column) -> tuple[DataFrame, list[str]]:
    """(rule_order, one key column per type, extra columns, value) for every row and rule, from
    one scan, and the names of the key columns: a rule's key stands in the one of its type."""
    kinds = sorted({kind for _, _, kind in items})
    names = [f"key{i}" for i in range(len(kinds))]
    rows = F.array(*[F.struct(
        F.lit(rule.rule_order).cast("bigint").alias("rule_order"),
        *[(key if own == kind else F.lit(None)).cast(kind).alias(name) for name, kind in zip(names, kinds)],
        *extra, col(rule.column_name).cast("string").alias("value")) for rule, key, own in items])
    return df.select(F.inline(rows)), names


def _keyed(df: DataFrame, rules: list[Rule], layouts: dict[str, str], *extra: Column) -> tuple[DataFrame, list[str]]:
    """The values of uniqueness rules as typed keys."""
    items = []
    for r in rules:
        value = _seen(df, r, layouts)
        items.append((r, *_comparable(value, df.select(value.alias("v")).schema["v"].dataType)))
    return _stacked(df, items, *extra)


def _sets(df: DataFrame, rules: list[Rule], *extra: Column) -> tuple[DataFrame, DataFrame, list[str]]:
    """The values of rules with large sets as typed keys, the sets as a table of (rule_order,
    typed keys), and the names of the key columns."""
    found = {r.rule_order: set_members(df.schema[r.column_name].dataType, r.value_set) for r in rules}
    pairs, names = _stacked(df, [(r, col(r.column_name).cast(found[r.rule_order][0]), found[r.rule_order][0])
                                 for r in rules], *extra)
    kinds = sorted({kind for kind, _ in found.values()})
    rows = [(order, *[m if own == kind else None for own in kinds]) for order, (kind, members) in found.items()
            for m in members]
    members = df.sparkSession.createDataFrame(
        rows, ", ".join(["rule_order bigint", *(f"{n} {k}" for n, k in zip(names, kinds))]))
    given = F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()
    return pairs.where(given), members, names


def _outside(pairs: DataFrame, members: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose key is in no set of their rule."""
    left, right = pairs.alias("p"), members.alias("m")
    same = [F.col(f"p.{n}").eqNullSafe(F.col(f"m.{n}")) for n in names]
    on = F.col("p.rule_order") == F.col("m.rule_order")
    for test in same:
        on = on & test
    return left.join(right, on, "left_anti")


def require_key(df: DataFrame, key: str) -> None:
    """Raises if the key is null or repeated: "first" would not be defined."""
    bad = (df.groupBy(col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
           .where("k IS NULL OR n > 1").head(1))
    if bad:
        raise ValueError(f"column '{key}' is no key: value {bad[0].k!r} stands in {bad[0].n} rows")


def validate(df: DataFrame, rules, as_of: str | None = None,
             semantic_types: dict[str, str] | None = None,
             skip_empty: bool = False, layouts: dict[str, str] | None = None) -> DataFrame:
    """One row per rule: failing_count, success and, where it could not run, an error.

    ``layouts`` of numeric dates, by column, are found in the table if not given.

    ``skip_empty`` treats a column without any value as missing, so its rules pass."""
    spark, df = df.sparkSession, nan_to_null(df)
    suite = as_rules(rules)
    layouts = date_layouts(df, [r.column_name for r in suite]) if layouts is None else layouts
    checks = plan_checks(df, suite, as_of, semantic_types, layouts)
    notes = {id(r): (ok, text) for r, ok, text in checks.fixed}
    rows = [(r.rule_order, r.expectation_type, r.column_name, _text(r.min_value),
             _text(r.max_value), [str(v) for v in r.value_set], r.regex, r.type_, r.reasoning,
             *notes.get(id(r), (None, None))) for r in suite]
    schema = RESULT_SCHEMA.replace("failing_count bigint, success boolean, error string",
                                   "fixed_success boolean, error string")
    suite_table = spark.createDataFrame(rows, schema)
    counted = _counted(df, checks, layouts)
    if counted is None:
        counted = spark.createDataFrame(
            [], "rule_order bigint, failing_count bigint, filled bigint")
    # no row for a uniqueness rule: the table is empty
    no_values = F.when(F.col("fixed_success").isNull(), F.coalesce("filled", F.lit(0)) == 0)
    empty = F.lit(skip_empty) & F.coalesce(no_values, F.lit(False))
    return (suite_table.join(F.broadcast(counted), "rule_order", "left")
            .withColumn("failing_count",
                        F.when(empty, 0).otherwise(F.coalesce("failing_count", F.lit(0))))
            .withColumn("success", F.coalesce("fixed_success", F.col("failing_count") == 0))
            .withColumn("error", F.when(empty, F.concat(
                F.lit("Column '"), F.col("column_name"), F.lit("' has no values — skipped")))
                .otherwise(F.col("error")))
            .select([c.split()[0] for c in RESULT_SCHEMA.split(", ")]))


def validate_fleet(tables: dict[str, DataFrame], rules, as_of: str | None = None,
                   semantics: DataFrame | None = None, skip_empty: bool = False) -> DataFrame:
    """Results of many tables in one job: each table's rules are those whose ``dataset`` is its
    name, and so are their rows. ``semantics`` is (dataset, column_name, semantic_type)."""
    rows = [r.asDict() if isinstance(r, Row) else dict(r)
            for r in (rules.collect() if isinstance(rules, DataFrame) else rules)]
    types: dict[str, dict[str, str]] = {}
    if semantics is not None:
        for r in semantics.select("dataset", "column_name", "semantic_type").collect():   # one row per column
            types.setdefault(r.dataset, {})[r.column_name] = r.semantic_type
    unknown = {r["dataset"] for r in rows} - set(tables)
    if unknown:
        raise ValueError(f"rules for tables that are not given: {sorted(unknown)}")
    parts = [validate(df, own, as_of, types.get(name), skip_empty).select(F.lit(name).alias("dataset"), "*")
             for name, df in tables.items() if (own := [r for r in rows if r["dataset"] == name])]
    if not parts:
        raise ValueError("no rules are given")
    return reduce(DataFrame.unionByName, parts)


def _text(value) -> str | None:
    return None if value is None else str(value)


def suite_statistics(results: DataFrame) -> DataFrame:
    """Evaluated, successful and failed rules, success percent and the overall verdict."""
    passed = F.count_if("success")
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("evaluated_expectations"), passed.alias("successful_expectations"),
        (total - passed).alias("unsuccessful_expectations"),
        F.coalesce(F.round(F.try_divide(passed, total) * 100, 1), F.lit(0.0))
        .alias("success_percent"),
        (total == passed).alias("success"))


def missing_suite(spark: SparkSession, suite: str) -> DataFrame:
    """The result of validating against a suite that does not exist."""
    return spark.createDataFrame(
        [(0, 0, 0, 0.0, False, f"Suite '{suite}' not found")],
        "evaluated_expectations bigint, successful_expectations bigint, "
        "unsuccessful_expectations bigint, success_percent double, success boolean, "
        "error string")


def _named(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows with the type and column of their rule: one broadcast row per rule."""
    names = rows.sparkSession.createDataFrame(
        [(r.rule_order, r.expectation_type, r.column_name) for r in rules],
        "rule_order bigint, expectation_type string, column_name string")
    return rows.join(F.broadcast(names), "rule_order")


def failing_rows(df: DataFrame, rules, key: str, as_of: str | None = None,
                 semantic_types: dict[str, str] | None = None,
                 layouts: dict[str, str] | None = None) -> DataFrame:
    """Every (rule_order, expectation_type, column_name, key, value) that breaks a rule.

    ``key`` is a unique, non-null column. Uniqueness failures are found by what remains
    after removing the rows whose value occurs once: an anti-join on the unique key, so a
    hot value spreads over all tasks."""
    df, suite = nan_to_null(df), as_rules(rules)
    layouts = date_layouts(df, [r.column_name for r in suite]) if layouts is None else layouts
    checks = plan_checks(df, suite, as_of, semantic_types, layouts)
    schema = ["rule_order", "expectation_type", "column_name", "key", "value"]
    parts = []
    if checks.unique:
        require_key(df, key)
    if checks.local:
        hits = [F.when(mask, F.struct(
            F.lit(r.rule_order).cast("bigint").alias("rule_order"),
            F.lit(r.expectation_type).alias("expectation_type"),
            F.lit(r.column_name).alias("column_name"), col(key).alias("key"),
            col(r.column_name).cast("string").alias("value"))) for r, mask in checks.local]
        parts.append(df.select(F.inline(
            F.filter(F.array(*hits), lambda h: h.isNotNull()))).select(schema))
    if checks.unique:
        pairs, keys = _keyed(df, checks.unique, layouts, col(key).alias("key"))
        single = (pairs.groupBy("rule_order", *keys).agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
                  .where("n = 1").select("rule_order", "key"))
        parts.append(_named(pairs.join(single, ["rule_order", "key"], "left_anti"), checks.unique).select(schema))
    if checks.sets:
        pairs, members, keys = _sets(df, checks.sets, col(key).alias("key"))
        parts.append(_named(_outside(pairs, members, keys), checks.sets).select(schema))
    if not parts:
        return df.sparkSession.createDataFrame([], T.StructType(
            [T.StructField("rule_order", T.LongType())]
            + [T.StructField(c, T.StringType()) for c in schema[1:3]]
            + [T.StructField("key", df.schema[key].dataType), T.StructField("value", T.StringType())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failing_keys(df: DataFrame, rules, key: str, as_of: str | None = None,
                 semantic_types: dict[str, str] | None = None,
                 limit: int = FAILING_KEYS) -> DataFrame:
    """The first ``limit`` failing keys of each rule. The rank filter is applied before
    the shuffle, so at most ``limit`` rows per rule leave a task."""
    w = Window.partitionBy("rule_order").orderBy("key")
    return (failing_rows(df, rules, key, as_of, semantic_types)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit))
