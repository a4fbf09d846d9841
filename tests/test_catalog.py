import os

from dataward.operators import catalog

SCHEMA = "table_name string, column_name string, n int"
KEYS = ["table_name", "column_name"]


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    path = str(tmp_path / "tags")
    rows = [(f"t{i % 50}", f"c{i}", i) for i in range(500)]
    written = catalog.upsert_stored(path, spark.createDataFrame(rows, SCHEMA), KEYS)
    assert written == catalog.BUCKETS
    before = files(path)
    changes = [("t1", "c1", -1), ("t2", "c2", -2), ("t9", "new", 0), (None, "c", 7)]
    written = catalog.upsert_stored(path, spark.createDataFrame(changes, SCHEMA), KEYS)
    assert 0 < written <= 4
    after = files(path)
    assert len({os.path.dirname(f) for f in after - before}) == written
    assert len({os.path.dirname(f) for f in before - after}) <= written
    want = {(t, c): n for t, c, n in rows} | {(t, c): n for t, c, n in changes}
    got = catalog.read_stored(spark, path)
    assert got.columns == ["table_name", "column_name", "n"]
    assert {(r.table_name, r.column_name): r.n for r in got.collect()} == want and got.count() == len(want)


def test_no_changes(spark, tmp_path):
    path = str(tmp_path / "none")
    assert catalog.upsert_stored(path, spark.createDataFrame([], SCHEMA), KEYS) == 0
    assert not os.path.exists(path)
