from collections import Counter
from statistics import median

from pyspark.sql import functions as F

from dataward.operators import lineage

EDGES = "src_table string, src_col string, tgt_table string, tgt_col string, transform string, edge_order bigint"


def edges(spark, n):
    """A third of the edges leave one column, a third end in one, the rest have their own."""
    rows = [("hot" if i % 3 == 0 else f"s{i}", "c" if i % 3 == 0 else f"c{i % 5}", "mart" if i % 3 == 1 else f"t{i}", "total",
             "direct", i) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "c", "t", None, None, n)], EDGES)


def test_hot_tables_spread_without_adaptive_help(spark):
    found = spark.createDataFrame([("hot", "c", "EMAIL"), ("mart", "total", "SSN"), ("s2", "c2", "PAN"), ("unused", "x", "PAN")],
                                  "table_name string, column_name string, pii_type string")
    df = edges(spark, 6000)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        tagged = lineage.tag_edges(df, found, per_salt=100).withColumn("task", F.spark_partition_id())
        rows = tagged.collect()
        sizes = Counter(r.task for r in rows)
        plain = Counter(r.p for r in df.repartition(8, "src_table", "src_col").select(F.spark_partition_id().alias("p")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes.values()) < 2 * median(sizes.values()) < max(plain.values())
    assert len(rows) == 6001
    for r in rows:
        src = {"hot": "EMAIL"}.get(r.src_table) or ("PAN" if (r.src_table, r.src_col) == ("s2", "c2") else None)
        tgt = "SSN" if r.tgt_table == "mart" else None
        assert (r.src_pii, r.tgt_pii, r.pii) == (src, tgt, src or tgt or "—")
