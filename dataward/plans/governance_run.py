"""The governance run: lineage edges, detections, risk, masking, catalog."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.operators import catalog, lineage
from dataward.operators.masking import mask_tables
from dataward.operators.pii import detect_pii
from dataward.operators.risk import recommendations, risk_report, risk_scores


@dataclass
class GovernanceRun:
    edges: DataFrame
    detections: DataFrame
    report: DataFrame
    advice: DataFrame
    masked: dict[str, DataFrame] = field(default_factory=dict)


def governance_run(tables: dict[str, DataFrame], edges: DataFrame) -> GovernanceRun:
    """Scan the tables the edges name, score the risk and mask what was found.

    ``tables`` maps names to readable tables; edge ends without one are skipped."""
    unique = lineage.deduplicate_edges(edges)
    named = {r.t for r in unique.select(
        F.explode(F.array("src_table", "tgt_table")).alias("t"))
        .where(F.col("t").isin(list(tables))).distinct().collect()}
    scanned = {name: df for name, df in tables.items() if name in named}
    spark = edges.sparkSession
    found = detect_pii(scanned)
    rows = found.collect()                            # one row per sensitive column
    found = spark.createDataFrame(rows, found.schema)
    counts = unique.agg(F.count(F.lit(1)).alias("edges"))
    return GovernanceRun(
        edges=unique, detections=found, report=risk_report(found, unique),
        advice=recommendations(found, risk_scores(found, counts)),
        masked=mask_tables(scanned, found))


def persist_run(run: GovernanceRun, stored: dict[str, DataFrame], created_at,
                source_sql: str = "", profiles: DataFrame | None = None
                ) -> dict[str, DataFrame]:
    """New versions of the five catalog tables after a run."""
    tables = catalog.upsert_target_tables(
        stored.get("catalog_tables"), run.edges, source_sql, created_at, profiles)
    tables = catalog.flag_tables(tables, run.detections)
    return {
        "lineage_edges": catalog.upsert_edges(
            stored.get("lineage_edges"), run.edges, created_at),
        "catalog_tables": catalog.apply_risk(tables, run.report, run.advice),
        "pii_tags": catalog.upsert_tags(stored.get("pii_tags"), run.detections, created_at),
        "catalog_columns": catalog.upsert_columns(
            stored.get("catalog_columns"), run.detections, profiles, bool(run.masked)),
        "governance_reports": catalog.append_report(
            stored.get("governance_reports"), run.report, run.advice, created_at),
    }
