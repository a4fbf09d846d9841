import hashlib
from datetime import date
from decimal import Decimal

from dataward.constants import IN_SET, UNIQUE
from dataward.operators import validate
from dataward.operators.validate import failing_rows, set_members

LONG = "x" * 300
ROWS = [
    # text, real, list, map, record, money, flag, day, data, id
    ("a", 0.0, ["a, b"], {"a": 1, "b": 2}, (1, "x"), Decimal("1.00"), True, date(2020, 1, 1), b"\x00"),
    ("a", -0.0, ["a", "b"], {"b": 2, "a": 1}, (1, "x"), Decimal("1.01"), False, date(2020, 1, 1), b"\x00"),
    ("sha256:" + hashlib.sha256(LONG.encode()).hexdigest(), 1.5, [], {}, (2, "x"), Decimal("2.00"), None, None, b""),
    (LONG, float("nan"), [""], {"a": None}, None, Decimal("2.00"), None, date(2020, 1, 2), b"\x01"),
    (LONG, float("nan"), [""], {"a": 3}, None, None, None, date(2020, 1, 3), None),
    (None, None, None, None, (None, None), None, None, None, None),
    (LONG + "y", None, [None], None, (None, "x"), Decimal("3.10"), None, None, None)]
SCHEMA = ("text string, real double, list array<string>, map map<string,int>, record struct<a:int,b:string>, "
          "money decimal(10,2), flag boolean, day date, data binary, id bigint")
EXPECTED = {"text": 4, "real": 2 + 4, "list": 2, "map": 2 + 2, "record": 2 + 2, "money": 2 + 2, "flag": 5, "day": 2 + 3,
            "data": 2 + 3}


def rule(order, kind, column, **more):
    return {"rule_order": order, "expectation_type": kind, "column_name": column, **more}


def test_counts_and_rows_of_unique_rules_agree_for_all_types(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], SCHEMA).repartition(3)
    rules = [rule(i, UNIQUE, c) for i, c in enumerate(EXPECTED)]
    counted = {r.column_name: r.failing_count for r in validate.validate(df, rules).collect()}
    found = {c: 0 for c in EXPECTED}
    for r in failing_rows(df, rules, "id").collect():
        found[r.column_name] += 1
    assert counted == found == EXPECTED


def test_unique_rules_take_one_scan(spark, tmp_path):
    spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], SCHEMA).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = failing_rows(df, [rule(i, UNIQUE, c) for i, c in enumerate(EXPECTED)], "id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2              # the rows, and the values that occur once


def test_sets_of_any_size_agree(spark, monkeypatch):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], SCHEMA)
    rules = [rule(0, IN_SET, "text", value_set=["a", LONG]), rule(1, IN_SET, "money", value_set=["1", "2.0", "3.123", "x"]),
             rule(2, IN_SET, "id", value_set=["1", 2.0, "3.5", 10**30]), rule(3, IN_SET, "real", value_set=[0, "1.5"]),
             rule(4, IN_SET, "flag", value_set=["true"]), rule(5, IN_SET, "day", value_set=[])]

    def both():
        counts = [(r.rule_order, r.failing_count, r.success) for r in
                  validate.validate(df, rules).orderBy("rule_order").collect()]
        rows = sorted((r.rule_order, r.key, r.value) for r in failing_rows(df, rules, "id").collect())
        return counts, rows

    literals = both()
    monkeypatch.setattr(validate, "SET_LITERALS", -1)
    assert both() == literals
    assert [n for _, n, _ in literals[0]] == [2, 2, 5, 0, 1, 4]


def test_members_follow_the_columns_type(spark):
    types = spark.createDataFrame([], SCHEMA + ", small int").schema
    assert set_members(types["money"].dataType, ["1", "1.005", 99999999.99, 10**9]) == (
        "decimal(10,2)", [Decimal("1"), Decimal("99999999.99")])
    assert set_members(types["small"].dataType, [1.0, "2", "2.5", "inf", None]) == ("bigint", [1, 2])
