"""Governance risk: score, level, recommendations and a report per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataward.constants import DEFAULT_WEIGHT, RISK_WEIGHTS, TOKENIZE_TYPES


def weight(pii_type: Column) -> Column:
    """Risk weight of a type; null when the type is unlisted."""
    table = F.create_map(*[F.lit(x) for pair in RISK_WEIGHTS.items() for x in pair])
    return F.try_element_at(table, pii_type)


def percent(value: Column) -> Column:
    return F.concat(F.round(value * 100).cast("int").cast("string"), F.lit("%"))


def risk_level(score: Column) -> Column:
    return (F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH")
            .when(score >= 0.3, "MEDIUM").otherwise("LOW"))


def risk_scores(detections: DataFrame, edge_counts: DataFrame | None = None,
                by: list[str] | None = None) -> DataFrame:
    """One row per group of ``by`` (one row in all without it): unrounded score and level.

    ``edge_counts`` is (by..., edges); more than five edges raise the score."""
    by = by or []
    risk = F.coalesce(weight(F.col("pii_type")), F.lit(DEFAULT_WEIGHT)) * F.coalesce(
        "confidence", F.lit(0.5))
    per_run = detections.groupBy(*by).agg(
        F.max(risk).alias("top_risk"), F.count(F.lit(1)).alias("pii_count"),
        F.array_join(F.array_sort(F.collect_set("pii_type")), ", ").alias("pii_types"),
        F.count_distinct("table_name").alias("pii_tables"))
    if edge_counts is None:
        per_run = per_run.withColumn("edges", F.lit(0).cast("bigint"))
    elif by:
        per_run = per_run.join(edge_counts, by, "left").withColumn(
            "edges", F.coalesce("edges", F.lit(0)))
    else:
        per_run = per_run.withColumn("edges", edge_counts.select("edges").scalar())
    # Ten decimals keep level and rounding free of binary noise around the limits.
    base = F.least(F.lit(1.0), F.round(
        F.col("top_risk") * 0.7 + F.col("pii_count") / 10 * 0.3, 10))
    score = F.when(F.col("edges") > 5, F.least(F.lit(1.0), F.round(base + 0.1, 10))
                   ).otherwise(base)
    return (per_run.withColumn("score", F.when(F.col("pii_count") > 0, score).otherwise(0.0))
            .withColumn("risk_level", risk_level(F.col("score"))))


def recommendations(detections: DataFrame, scores: DataFrame,
                    by: list[str] | None = None) -> DataFrame:
    """What to do per sensitive column, and audit logging for runs at high risk."""
    by = by or []
    w = weight(F.col("pii_type"))
    name, kind = F.col("column_name"), F.col("pii_type")

    def advice(test: Column, action: str, priority, *detail) -> Column:
        return F.when(test, F.struct(
            F.lit(action).alias("action"),
            (priority if isinstance(priority, Column) else F.lit(priority)).alias("priority"),
            F.concat(*[d if isinstance(d, Column) else F.lit(d) for d in detail])
            .alias("detail")))

    per_column = F.array(
        advice(F.lit(True), "mask",
               F.when(F.coalesce(w, F.lit(DEFAULT_WEIGHT)) >= 0.7, "HIGH").otherwise("MEDIUM"),
               "Apply ", kind, "-specific masking to '", name, "' (confidence: ",
               percent(F.coalesce("confidence", F.lit(0.5))), ")"),
        advice(w >= 0.8, "restrict_access", "CRITICAL",
               "Restrict access to '", name, "' — contains ", kind, " data"),
        advice(kind.isin(TOKENIZE_TYPES), "tokenize", "HIGH",
               "Consider tokenization for '", name, "' (", kind, ") for downstream analytics"))
    columns = detections.select(
        *by, "table_name", "column_name", "pii_type",
        F.inline(F.filter(per_column, lambda a: a.isNotNull())))
    audit = scores.where(F.col("risk_level").isin("HIGH", "CRITICAL")
                         & (F.col("pii_count") > 0)).select(
        *by, F.lit("*").alias("table_name"), F.lit("*").alias("column_name"),
        F.lit("GENERAL").alias("pii_type"), F.lit("audit_logging").alias("action"),
        F.lit("HIGH").alias("priority"),
        F.lit("Enable audit logging for all access to tables containing PII").alias("detail"))
    return columns.unionByName(audit)


def risk_report(detections: DataFrame, edges: DataFrame | None = None,
                by: list[str] | None = None) -> DataFrame:
    """One report row per run. Runs without detections are listed at LOW when edges know
    them."""
    by = by or []
    counts = tables = None
    if edges is not None:
        counts = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("edges"))
        tables = (edges.select(*by, F.explode(F.array("src_table", "tgt_table")).alias("t"))
                  .distinct().groupBy(*by).agg(F.count("t").alias("tables_analyzed")))
    scores = risk_scores(detections, counts, by)
    if tables is None:
        scores = scores.withColumn("tables_analyzed", F.lit(0).cast("bigint"))
    elif by:
        scores = scores.join(tables, by, "full")
    else:
        scores = scores.withColumn("tables_analyzed",
                                   tables.select("tables_analyzed").scalar())
    found = F.coalesce("pii_count", F.lit(0))
    level = F.coalesce("risk_level", F.lit("LOW"))
    score = F.coalesce("score", F.lit(0.0))
    summary = F.when(found == 0, "No PII detected. Data governance risk is minimal.").otherwise(
        F.concat(F.lit("Detected "), found.cast("string"), F.lit(" PII column(s) ("),
                 F.col("pii_types"), F.lit(") across "), F.col("pii_tables").cast("string"),
                 F.lit(" table(s). Overall risk: "), level, F.lit(" ("), percent(score),
                 F.lit(").")))
    return scores.select(
        *by, level.alias("risk_level"), F.round(score, 2).alias("risk_score"),
        summary.alias("summary"), found.alias("pii_count"),
        F.coalesce("tables_analyzed", F.lit(0)).alias("tables_analyzed"))
