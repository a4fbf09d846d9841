"""Column lineage held as a table of edges (src_table, src_col, tgt_table, tgt_col,
transform, edge_order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_KEY = ["src_table", "src_col", "tgt_table", "tgt_col"]
PER_SALT = 1_000_000        # rows of one key that meet in one task


def deduplicate_edges(edges: DataFrame) -> DataFrame:
    """One edge per key with the transform seen first. An aggregate, so that a pair
    logged again and again is combined before the shuffle."""
    return edges.groupBy(*EDGE_KEY).agg(
        F.min_by("transform", "edge_order").alias("transform"),
        F.min("edge_order").alias("edge_order"))


def sources_and_targets(edges: DataFrame) -> DataFrame:
    """(role, table_name): targets, and sources that are not themselves targets."""
    targets = edges.select(F.col("tgt_table").alias("table_name")).distinct()
    sources = edges.select(F.col("src_table").alias("table_name")).distinct().join(
        targets, "table_name", "left_anti")
    return sources.withColumn("role", F.lit("source")).unionByName(
        targets.withColumn("role", F.lit("target")))


def column_map(edges: DataFrame) -> DataFrame:
    """For every target column name the edge that came last."""
    last = F.max_by(F.struct("src_table", "src_col", "transform"), "edge_order")
    return edges.groupBy("tgt_col").agg(last.alias("e")).select(
        "tgt_col", F.col("e.src_table").alias("source_table"),
        F.col("e.src_col").alias("source_col"), F.col("e.transform").alias("transform"))


def flows(edges: DataFrame) -> DataFrame:
    """Edges and distinct transforms per table pair."""
    return edges.groupBy("src_table", "tgt_table").agg(
        F.count(F.lit(1)).alias("edges"),
        F.array_join(F.array_sort(F.collect_set("transform")), ",").alias("transforms"))


def salted_left_join(rows: DataFrame, facts: DataFrame, keys: list[str], per_salt: int = PER_SALT) -> DataFrame:
    """A left join in which no key puts more than about ``per_salt`` rows into one task.

    A counting pass, combined map-side, finds the heavy keys: one per ``per_salt`` rows at
    most, so they are small enough to be broadcast. Their rows are dealt over salts, and only
    their facts are repeated, once per salt."""
    heavy = F.broadcast(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_salt)
                        .select(*keys, F.ceil(F.col("n") / per_salt).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    place = F.pmod(F.xxhash64(*rows.columns), salts).cast("int")
    dealt = rows.join(heavy, keys, "left").withColumn("__salt", place).drop("__salts")
    repeated = (facts.join(heavy, keys, "left")
                .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts"))
    return dealt.join(repeated, [*keys, "__salt"], "left").drop("__salt")


def tag_edges(edges: DataFrame, detections: DataFrame, per_salt: int = PER_SALT) -> DataFrame:
    """Edges with the personal-data type at either end; the source's type is shown first.
    A table that many edges share does not end in one task (`salted_left_join`)."""
    tags = detections.select("table_name", "column_name", "pii_type")
    at_source = tags.select(F.col("table_name").alias("src_table"),
                            F.col("column_name").alias("src_col"),
                            F.col("pii_type").alias("src_pii"))
    at_target = tags.select(F.col("table_name").alias("tgt_table"),
                            F.col("column_name").alias("tgt_col"),
                            F.col("pii_type").alias("tgt_pii"))
    named = salted_left_join(edges, at_source, ["src_table", "src_col"], per_salt)
    return (salted_left_join(named, at_target, ["tgt_table", "tgt_col"], per_salt)
            .select(*edges.columns, "src_pii", "tgt_pii", F.coalesce("src_pii", "tgt_pii", F.lit("—")).alias("pii")))


def summary(edges: DataFrame, detections: DataFrame) -> DataFrame:
    """Number of sources, targets, edges and personal-data columns."""
    roles = sources_and_targets(edges).agg(
        F.count_if(F.col("role") == "source").alias("sources"),
        F.count_if(F.col("role") == "target").alias("targets"))
    size = edges.agg(F.count(F.lit(1)).alias("edges"))
    tagged = detections.select("table_name", "column_name").distinct().agg(
        F.count(F.lit(1)).alias("pii_columns"))
    return roles.select("*", size.scalar().alias("edges"),
                        tagged.scalar().alias("pii_columns"))
