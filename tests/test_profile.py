import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dataward.operators import classify, quantile
from dataward.operators.profile import profile
from dataward.operators.quantile import Extent, exact_quantiles

SCHEMA = "id bigint, price double, status string, sign_date string, email string, ok boolean"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 2.0, "a", "2020-01-01", "x@y.z", True), (2, -1.0, "a", "2099-01-01", "bad", False),
            (3, None, "b", "junk", None, None), (4, float("nan"), "", None, "q@r.s", True)]
    return spark.createDataFrame(rows, SCHEMA)


def test_profile_small(small):
    p = {r.column_name: r for r in profile(small, "t", "2026-01-01").collect()}
    assert (p["price"].null_count, p["price"].negative_count, p["price"].unique_count) == (2, 1, 2)
    assert (p["price"].p25, p["price"].p75, p["price"].mean) == (-0.25, 1.25, 0.5)
    assert p["sign_date"].dtype == "datetime"
    assert (p["sign_date"].null_count, p["sign_date"].future_date_count) == (2, 1)
    assert p["sign_date"].future_date_pct == 50.0
    assert (p["email"].valid_email_count, p["email"].invalid_email_count) == (2, 1)
    assert p["status"].has_empty_strings == 1
    # ties come in the order of the values' digests
    assert [(t.value, t.n) for t in p["status"].top_values] == [("a", 2), ("b", 1), ("", 1)]
    assert p["status"].category_values == p["status"].top_values
    assert [(t.value, t.n) for t in p["ok"].top_values] == [("true", 2), ("false", 1)]


def test_semantic_types(small):
    kinds = {r.column_name: r.semantic_type for r in
             classify.with_semantic_types(profile(small, "t", "2026-01-01")).collect()}
    assert kinds == {"id": "identifier", "price": "currency", "status": "free_text",
                     "sign_date": "datetime", "email": "email", "ok": "boolean"}


def test_long_text_is_grouped_by_digest(spark):
    df = spark.createDataFrame([("x" * 1000,), ("x" * 1000,), ("y" * 999 + "z",), ("short",)],
                               "body string")
    row = profile(df).first()
    assert row.unique_count == 3
    assert row.top_values[0].n == 2 and row.top_values[0].value == "x" * 1000
    assert {t.value for t in row.top_values} == {"x" * 1000, "y" * 999 + "z", "short"}


def test_distinct_longs_beyond_double_precision(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 2,)], "k bigint")
    assert profile(df).first().unique_count == 3


@pytest.mark.parametrize("limit, sorted_rows", [
    (1, 100), (7, 0), (50, 2500), (10_000, 0), (10_000, 100_000)])
def test_exact_quantiles_by_every_way(spark, monkeypatch, limit, sorted_rows):
    monkeypatch.setattr(quantile, "SORTED_ROWS", sorted_rows)
    rng = np.random.default_rng(5)
    columns = {
        "normal": rng.normal(size=3000), "heavy": np.exp(rng.normal(0, 20, size=2000)),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 500, 3000) / 8),
        "few": rng.integers(0, 5, 1000).astype(float),
    }
    ids = dict(enumerate(columns))
    frame = pd.concat([pd.DataFrame({"column_id": i, "value": columns[c]})
                       for i, c in ids.items()])
    freq = spark.createDataFrame(frame, "column_id int, value double").groupBy(
        "column_id", "value").agg(F.count(F.lit(1)).alias("n"))
    extents = {i: Extent(len(columns[c]), float(min(columns[c])), float(max(columns[c])))
               for i, c in ids.items()}
    got = exact_quantiles(freq, extents, [0.25, 0.5, 0.99], ["a", "b", "c"], limit).collect()
    assert {ids[r.column_id]: r.unique_count for r in got} == {
        c: len(set(v)) for c, v in columns.items()}
    for r in got:
        want = np.quantile(columns[ids[r.column_id]], [0.25, 0.5, 0.99])
        assert np.allclose([r.a, r.b, r.c], want, rtol=1e-12)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([], "a bigint, b string")
    assert {r.column_name: r.unique_count for r in profile(df).collect()} == {"a": 0, "b": 0}
    nulls = spark.createDataFrame([(None, None)], "a double, b string")
    assert {r.column_name: (r.null_pct, r.p25) for r in profile(nulls).collect()} == {
        "a": (100.0, None), "b": (100.0, None)}


def test_category_values_are_complete_or_null(spark):
    df = spark.createDataFrame([(f"v{i % 50}", f"w{i % 51}") for i in range(5000)], "few string, many string")
    p = {r.column_name: r for r in profile(df, "t").collect()}
    assert len(p["few"].category_values) == 50 and len(p["few"].top_values) == 10
    assert p["many"].category_values is None and len(p["many"].top_values) == 10


def test_score_of_a_dataset_without_columns(spark, small):
    scores = classify.quality_score(profile(small, "t", "2026-01-01"), ["t", "empty"])
    assert {r.dataset: r.quality_score for r in scores.collect()}["empty"] == 50


def test_one_shuffle_of_values_for_all_kinds(spark):
    df = spark.range(2000).selectExpr(
        "id", "id % 7 AS few", "cast(id AS double) / 3 AS real", "cast(id % 50 AS decimal(10, 2)) AS money",
        "concat('t', id % 30) AS text", "id % 2 = 0 AS flag", "timestamp_seconds(id) AS at")
    result = profile(df, as_of="2026-01-01")
    rows = {r.column_name: r for r in result.collect()}
    assert {c: r.unique_count for c, r in rows.items()} == {
        "id": 2000, "few": 7, "real": 2000, "money": 50, "text": 30, "flag": 2, "at": 2000}
    assert rows["few"].p75 == 5.0 and rows["money"].p25 == 12.0 and rows["flag"].top_values[0].n == 1000
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    of_values = [line for line in plan.splitlines() if "Exchange hashpartitioning(column_id" in line and "whole" in line]
    assert len([line for line in of_values if "Reused" not in line]) == 1


def test_rows_are_dealt_out_before_values_are_counted(spark, monkeypatch):
    from dataward.operators import profile as module
    df = spark.range(1000).selectExpr("id AS k", "concat('v', id % 7) AS v", "repeat(concat('w', id % 3), 200) AS w",
                                      "if(id % 2 = 0, id / 4, NULL) AS x")
    want = profile(df, "t", "2026-01-01").orderBy("ordinal").collect()
    monkeypatch.setattr(module, "TASK_ROWS", 100, raising=False)
    got = profile(df, "t", "2026-01-01")
    assert got.orderBy("ordinal").collect() == want
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
