"""Projections over the profile table: semantic type, health, issues, score, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataward.constants import (
    BOOLEAN_WORDS,
    CURRENCY_NAMES,
    DATETIME_NAMES,
    EMAIL_NAMES,
    ID_SUFFIXES,
    PHONE_NAMES,
    PRIORITY_TYPES,
    URL_NAMES,
)
from dataward.functions.coerce import strip
from dataward.functions.names import any_of


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def semantic_type() -> Column:
    """First matching rule wins."""
    name = F.lower(F.trim(F.col("column_name")))
    dtype, unique, share = F.col("dtype"), F.col("unique_count"), F.col("unique_pct")
    top = F.coalesce(F.transform("top_values", lambda t: strip(F.lower(t["value"]))),
                     F.array().cast("array<string>"))
    boolean = (F.size(top) > 0) & F.forall(top, lambda v: v.isin(BOOLEAN_WORDS)) & (unique <= 4)
    return (
        F.when((_count("valid_email_count") > 0) | name.rlike(any_of(EMAIL_NAMES)), "email")
        .when(name.rlike(any_of(URL_NAMES)), "url")
        .when(name.rlike(any_of(PHONE_NAMES)), "phone")
        .when((dtype == "datetime") | name.rlike(any_of(DATETIME_NAMES)), "datetime")
        .when((dtype == "boolean") | boolean, "boolean")
        .when((dtype == "object") & unique.between(2, 50) & (share < 10), "categorical")
        .when(name.rlike(f"({any_of(ID_SUFFIXES)})$") & (share > 70), "identifier")
        .when(name.rlike(any_of(CURRENCY_NAMES)), "currency")
        .when(dtype == "int", "integer")
        .when(dtype == "float", "float")
        .when((dtype == "object") & (share > 60), "free_text")
        .otherwise("unknown"))


def with_semantic_types(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("semantic_type", semantic_type())


def settled(profiles: DataFrame) -> DataFrame:
    """The same rows as a local table: one row per column, computed once. Rules and plans
    refer to them many times."""
    return profiles.sparkSession.createDataFrame(profiles.collect(), profiles.schema)


def health_status() -> Column:
    null_pct, future = F.col("null_pct"), _count("future_date_pct")
    return (F.when((null_pct > 20) | (future > 5) | (_count("invalid_email_count") > 0),
                   "CRITICAL")
            .when((null_pct > 5) | (_count("negative_count") > 0), "WARNING")
            .otherwise("HEALTHY"))


def issues() -> Column:
    """Messages for what is wrong with a column, in fixed order."""
    found = [
        (F.col("null_pct") > 5, F.col("null_pct"), "% null values"),
        (_count("negative_count") > 0, F.col("negative_count"), " negative values"),
        (_count("future_date_pct") > 0, F.col("future_date_pct"), "% future dates"),
        (_count("invalid_email_count") > 0, F.col("invalid_email_count"),
         " invalid email addresses"),
        (_count("has_empty_strings") > 0, F.col("has_empty_strings"), " empty strings"),
    ]
    return F.filter(
        F.array(*[F.when(test, F.concat(n.cast("string"), F.lit(text)))
                  for test, n, text in found]),
        lambda message: message.isNotNull())


def column_health(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns({"health_status": health_status(), "issues": issues()})


def quality_score(profiles: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """0 to 100 per dataset, from the mean penalty of its columns. Of the named ``datasets``,
    those without a profiled column get 50."""
    penalty = (F.least(F.col("null_pct") / 100, F.lit(0.3))
               + F.when(_count("negative_count") > 0, 0.1).otherwise(0.0)
               + F.when(_count("future_date_pct") > 0, 0.2).otherwise(0.0))
    score = F.greatest(F.lit(0), F.floor(100 - F.round(F.avg(penalty) * 100, 9)))
    found = profiles.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"), score.cast("bigint").alias("quality_score"))
    if datasets is None:
        return found
    named = profiles.sparkSession.createDataFrame([(d,) for d in datasets], "dataset string")
    return named.join(found, "dataset", "left").na.fill({"columns": 0, "quality_score": 50})


def column_priority(profiles: DataFrame) -> DataFrame:
    """Rank columns for rule work: unhealthy or complex ones first, then table order."""
    typed = with_semantic_types(profiles).withColumn("health_status", health_status())
    first = (F.col("health_status").isin("CRITICAL", "WARNING")
             | F.col("semantic_type").isin(PRIORITY_TYPES))
    w = Window.partitionBy("dataset").orderBy(F.desc("is_priority"), "ordinal")
    return typed.withColumn("is_priority", first).withColumn(
        "priority_rank", F.row_number().over(w))
