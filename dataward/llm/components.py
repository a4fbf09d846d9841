"""Connected components by alternating large and small stars, each a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.session import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(a, b) for each pair of columns of every row; unlike a union it keeps the partitions."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs])))


FEW = 100_000               # edges that one task takes without a shuffle, 32 bytes each


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the root is the component's smallest node.
    Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    They only make edges fewer, so once there are few, rounds need no shuffle."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = now.coalesce(1) if mark[0] <= FEW else now
        both = _each(now, ("a", "b"), ("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(low, "a")
        small = _each(kept, ("b", "m"), ("a", "m")).filter("a <> b").distinct()
        now = materialize(small, "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return _each(now, ("a", "b"), ("b", "b")).select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
