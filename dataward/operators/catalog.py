"""Metadata catalog: keyed upserts that build a new version of a table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.operators.lineage import EDGE_KEY, deduplicate_edges, sources_and_targets
from dataward.session import materialize

SCHEMAS = {
    "catalog_tables": (
        "table_name string, source_sql string, created_at timestamp, row_count bigint, "
        "column_count bigint, has_pii int, risk_level string"),
    "catalog_columns": (
        "table_name string, column_name string, data_type string, is_pii int, "
        "pii_type string, pii_confidence double, sensitivity string, masked int"),
    "lineage_edges": (
        "src_table string, src_col string, tgt_table string, tgt_col string, "
        "transform string, created_at timestamp"),
    "pii_tags": (
        "table_name string, column_name string, pii_type string, confidence double, "
        "detection_method string, sample_values string, created_at timestamp"),
    "governance_reports": (
        "risk_level string, risk_score double, summary string, recommendations string, "
        "pii_count bigint, tables_analyzed bigint, created_at timestamp"),
}
KEYS = {
    "catalog_tables": ["table_name"],
    "catalog_columns": ["table_name", "column_name"],
    "lineage_edges": EDGE_KEY,
    "pii_tags": ["table_name", "column_name"],
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def latest(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last change per key. An aggregate, combined map-side: a key changed a billion times
    is no hot spot."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(
            *keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(changes.columns)


def upsert(existing: DataFrame | None, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes, one per key, replace the stored rows of their keys entirely."""
    if existing is None:
        return changes
    return existing.join(changes.select(keys), keys, "left_anti").unionByName(changes)


BUCKETS = 64                # of a stored catalog table; one is rewritten as a whole


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def upsert_stored(path: str, changes: DataFrame, keys: list[str]) -> int:
    """Upsert into a table stored below ``path`` in buckets of its keys; returns how many
    buckets were rewritten. Only the buckets of changed keys are read and written, all others
    keep their files. The new rows are written elsewhere first, as a folder that is read cannot
    be written; a run that fails in between leaves the old rows."""
    spark = changes.sparkSession
    batch = changes.withColumn("bucket", _bucket(keys))
    touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())      # BUCKETS at most
    if not touched:
        return 0
    try:
        stored = spark.read.schema(batch.schema).parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    merged = upsert(stored, batch, [*keys, "bucket"])
    (materialize(merged, "catalog").repartition("bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return len(touched)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_edges(existing: DataFrame | None, edges: DataFrame, created_at) -> DataFrame:
    """Store edges; of one batch the first transform per key counts."""
    batch = deduplicate_edges(edges).select(
        *EDGE_KEY, F.coalesce("transform", F.lit("direct")).alias("transform"),
        F.lit(created_at).cast("timestamp").alias("created_at"))
    return upsert(existing, batch, EDGE_KEY)


def upsert_target_tables(existing: DataFrame | None, edges: DataFrame, source_sql: str,
                         created_at, profiles: DataFrame | None = None) -> DataFrame:
    """Store target tables. A replaced row starts over: no personal data, LOW risk.

    Row and column counts come from profiles where there are any."""
    targets = sources_and_targets(edges).where(F.col("role") == "target").select("table_name")
    if profiles is None:
        sized = targets.withColumns({"row_count": F.lit(None).cast("bigint"),
                                     "column_count": F.lit(None).cast("bigint")})
    else:
        sizes = profiles.groupBy(F.col("dataset").alias("table_name")).agg(
            F.max("total_rows").alias("row_count"),
            F.count(F.lit(1)).alias("column_count"))
        sized = targets.join(sizes, "table_name", "left")
    batch = sized.select(
        "table_name", F.lit(source_sql).alias("source_sql"),
        F.lit(created_at).cast("timestamp").alias("created_at"), "row_count", "column_count",
        F.lit(0).alias("has_pii"), F.lit("LOW").alias("risk_level"))
    return upsert(existing, batch, KEYS["catalog_tables"])


def upsert_tags(existing: DataFrame | None, detections: DataFrame, created_at) -> DataFrame:
    """Store detections; samples become JSON text."""
    batch = detections.select(
        "table_name", "column_name", "pii_type",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("detection_method", F.lit("")).alias("detection_method"),
        F.to_json(F.coalesce("sample_values", F.expr("cast(array() as array<string>)")))
        .alias("sample_values"),
        F.lit(created_at).cast("timestamp").alias("created_at"))
    return upsert(existing, batch, KEYS["pii_tags"])


def upsert_columns(existing: DataFrame | None, tags: DataFrame,
                   profiles: DataFrame | None = None, masked: bool = False) -> DataFrame:
    """Store column sensitivity from tags, with the data type where profiles know it."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    batch = tags.select(
        "table_name", "column_name", F.lit(1).alias("is_pii"), "pii_type",
        confidence.alias("pii_confidence"),
        F.when(confidence >= 0.7, "HIGH").otherwise("MEDIUM").alias("sensitivity"),
        F.lit(int(masked)).alias("masked"))
    if profiles is None:
        batch = batch.withColumn("data_type", F.lit(None).cast("string"))
    else:
        types = profiles.select(F.col("dataset").alias("table_name"), "column_name",
                                F.col("dtype").alias("data_type"))
        batch = batch.join(types, ["table_name", "column_name"], "left")
    columns = [c.split()[0] for c in SCHEMAS["catalog_columns"].split(", ")]
    return upsert(existing, batch.select(columns), KEYS["catalog_columns"])


def flag_tables(tables: DataFrame, detections: DataFrame) -> DataFrame:
    """Mark stored tables that hold personal data."""
    found = detections.select("table_name").distinct().withColumn("found", F.lit(1))
    return (tables.join(found, "table_name", "left")
            .withColumn("has_pii", F.coalesce("found", "has_pii")).drop("found")
            .select(tables.columns))


def append_report(existing: DataFrame | None, report: DataFrame, advice: DataFrame,
                  created_at) -> DataFrame:
    """Append the report of one run, its recommendations as JSON. Recommendations are
    bounded by the sensitive columns of the run."""
    texts = advice.agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        "table_name", "column_name", "pii_type", "action", "priority", "detail"))))
        .alias("recommendations"))
    row = report.select(
        "risk_level", "risk_score", "summary", texts.scalar().alias("recommendations"),
        "pii_count",
        "tables_analyzed", F.lit(created_at).cast("timestamp").alias("created_at"))
    return row if existing is None else existing.unionByName(row)


def apply_risk(tables: DataFrame, report: DataFrame, advice: DataFrame) -> DataFrame:
    """Stored tables named by a recommendation take the report's risk level."""
    named = (advice.where(F.col("table_name") != "*").select("table_name").distinct()
             .withColumn("new_level", report.select("risk_level").scalar()))
    return (tables.join(named, "table_name", "left")
            .withColumn("risk_level", F.coalesce("new_level", "risk_level"))
            .drop("new_level").select(tables.columns))
