"""Rule suites: generated from profiles, or proposed by a user and then repaired.

A rule row is (dataset, rule_order, expectation_type, column_name, min_value, max_value,
value_set, regex, type_, reasoning); bounds are text so that one column holds numbers,
dates and the word "today".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.constants import (
    BETWEEN,
    EMAIL_REGEX,
    IN_SET,
    MIN_DATE,
    NOT_NULL,
    NUMERIC_TYPES,
    REGEX,
    RULE_SYNONYMS,
    RULE_TYPES,
    UNIQUE,
)
from dataward.functions.names import abs_is_safe

RULE_SCHEMA = (
    "dataset string, rule_order bigint, expectation_type string, column_name string, "
    "min_value string, max_value string, value_set array<string>, regex string, "
    "type_ string, reasoning string")
RULE_COLUMNS = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
GENERATED_FROM = 1_000_000      # generated rules are ordered after proposed ones


def _lower_bound() -> Column:
    return F.least(F.lit(0.0), F.col("min_value"))


def _upper_bound(top: Column) -> Column:
    return F.when(top < 0, top).otherwise(F.round(top * 1.5, 4))


def _value_set(min_share: float = 0.0) -> Column:
    """All values of a column with few of them, the most frequent first; null for others. A
    part of the values would make the rest look wrong."""
    kept = F.filter("category_values", lambda t: t["n"] >= F.col("total_count") * min_share)
    return F.transform(kept, lambda t: t["value"])


def generate_rules(profiles: DataFrame, min_share: float = 0.0) -> DataFrame:
    """Rules for every column of every profiled dataset (needs ``semantic_type``).

    ``min_share`` leaves values rarer than that share out of generated value sets."""
    kind, name = F.col("semantic_type"), F.col("column_name")
    numeric = kind.isin(NUMERIC_TYPES) & F.col("min_value").isNotNull()
    unsigned_errors = numeric & (F.col("negative_count") > 0) & abs_is_safe(name)
    values = _value_set(min_share)

    def rule(test: Column, expectation: str, why: str, low=None, high=None, values=None,
             regex=None) -> Column:
        def text(value):
            return F.lit(value) if value is None or isinstance(value, str) else value
        return F.when(test, F.struct(
            F.lit(expectation).alias("expectation_type"),
            text(low).cast("string").alias("min_value"),
            text(high).cast("string").alias("max_value"),
            text(values).cast("array<string>").alias("value_set"),
            text(regex).cast("string").alias("regex"),
            F.concat(F.lit(why), F.lit(" "), name).alias("reasoning")))

    rules = F.array(
        rule((F.col("null_pct") < 5) | (kind == "email"), NOT_NULL, "few or no nulls in"),
        rule(kind == "identifier", UNIQUE, "identifier"),
        rule(unsigned_errors, BETWEEN, "negative values are errors in",
             F.lit(0.0), _upper_bound(F.col("max_value"))),
        rule(numeric & ~F.coalesce(unsigned_errors, F.lit(False)), BETWEEN,
             "observed range of", _lower_bound(), _upper_bound(F.col("max_value"))),
        rule(kind == "datetime", BETWEEN, "dates up to today in", MIN_DATE, "today"),
        rule((kind == "categorical") & (F.size(values) > 0), IN_SET, "known values of",
             values=values),
        rule(kind == "email", REGEX, "address format of", regex=EMAIL_REGEX))
    return (profiles
            .select("dataset", "ordinal", "column_name", F.posexplode(
                F.filter(rules, lambda r: r.isNotNull())).alias("position", "rule"))
            .select("dataset",
                    (F.lit(GENERATED_FROM) + F.col("ordinal") * 10 + F.col("position"))
                    .cast("bigint").alias("rule_order"),
                    F.col("rule.expectation_type").alias("expectation_type"), "column_name",
                    "rule.min_value", "rule.max_value", "rule.value_set", "rule.regex",
                    F.lit(None).cast("string").alias("type_"), "rule.reasoning")
            .select(RULE_COLUMNS))


def canonical_type(name: Column) -> Column:
    synonyms = F.create_map(*[F.lit(x) for pair in RULE_SYNONYMS.items() for x in pair])
    return F.coalesce(F.try_element_at(synonyms, name), name)


def sanitize_rules(proposed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Keep proposals on existing columns with a known type, and repair their arguments.

    Optional boolean columns ``min_given`` / ``max_given`` mark a bound as set on purpose,
    so that an explicit null stays unbounded."""
    for flag in ("min_given", "max_given"):
        if flag not in proposed.columns:
            proposed = proposed.withColumn(flag, F.lit(False))
    facts = profiles.select(
        "dataset", "column_name", "semantic_type",
        F.col("min_value").alias("seen_min"), F.col("max_value").alias("seen_max"),
        F.transform(F.coalesce("category_values", F.expr(
            "cast(array() as array<struct<value:string,n:bigint>>)")),
            lambda t: t["value"]).alias("seen_values"))
    known = (proposed
             .where(F.col("expectation_type").isNotNull() & (F.col("expectation_type") != "")
                    & F.col("column_name").isNotNull())
             .withColumn("wanted", canonical_type(F.col("expectation_type")))
             .where(F.col("wanted").isin(RULE_TYPES))
             .join(facts, ["dataset", "column_name"]))

    kind, wanted = F.col("semantic_type"), F.col("wanted")
    name = F.lower("column_name")
    numeric = kind.isin(NUMERIC_TYPES)
    dated = (kind == "datetime") | name.contains("date") | name.contains("time")
    has_values = F.size("seen_values") > 0
    final = (F.when((wanted == IN_SET) & numeric, BETWEEN)
             .when((wanted == REGEX) & (kind == "categorical"), IN_SET)
             .otherwise(wanted))
    open_set = F.coalesce(F.size("value_set"), F.lit(0)) <= 0
    needs_values = (((wanted == IN_SET) & ~numeric & open_set)
                    | ((wanted == REGEX) & (kind == "categorical")))

    # A range on a date column gets date bounds; one on a numeric column observed bounds.
    # A value set turned into a range always gets observed bounds.
    date_range = (wanted == BETWEEN) & dated
    number_range = ((wanted == BETWEEN) & ~dated & numeric) | ((wanted == IN_SET) & numeric)
    no_min = F.col("min_value").isNull() & ~F.coalesce("min_given", F.lit(False))
    no_max = F.col("max_value").isNull() & ~F.coalesce("max_given", F.lit(False))
    seen_low = F.least(F.lit(0.0), F.col("seen_min")).cast("string")
    seen_high = _upper_bound(F.col("seen_max")).cast("string")
    low = (F.when(date_range & no_min, F.lit(MIN_DATE))
           .when(number_range & no_min & F.col("seen_min").isNotNull(), seen_low)
           .otherwise(F.col("min_value")))
    high = (F.when(date_range & no_max, F.lit("today"))
            .when(number_range & no_max & F.col("seen_max").isNotNull(), seen_high)
            .otherwise(F.col("max_value")))
    return (known.where(~needs_values | has_values)
            .select(
                "dataset", "rule_order", final.alias("expectation_type"), "column_name",
                low.alias("min_value"), high.alias("max_value"),
                F.when(needs_values, F.col("seen_values"))
                .when((wanted == IN_SET) & numeric, F.lit(None))
                .otherwise(F.col("value_set")).alias("value_set"),
                F.when((wanted == REGEX) & (kind == "categorical"), F.lit(None))
                .when((wanted == REGEX) & (kind == "email"), F.lit(EMAIL_REGEX))
                .otherwise(F.col("regex")).alias("regex"),
                "type_",
                F.when(F.coalesce("reasoning", F.lit("")) != "", F.col("reasoning"))
                .otherwise(F.concat(
                    F.lit("Auto-generated rule for '"), F.col("column_name"),
                    F.lit("' (semantic type: "), kind, F.lit(", check: "), final, F.lit(")")))
                .alias("reasoning")))


def deduplicate_rules(rules: DataFrame) -> DataFrame:
    """Per dataset, column and type keep the first rule."""
    w = Window.partitionBy("dataset", "expectation_type", "column_name").orderBy("rule_order")
    return (rules.withColumn("place", F.row_number().over(w))
            .where(F.col("place") == 1).drop("place"))


def build_suite(profiles: DataFrame, proposed: DataFrame | None = None,
                min_share: float = 0.0) -> DataFrame:
    """Repaired proposals first, generated rules for what they leave open."""
    rules = generate_rules(profiles, min_share)
    if proposed is not None:
        rules = sanitize_rules(proposed, profiles).unionByName(rules)
    return deduplicate_rules(rules)
