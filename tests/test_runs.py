from pyspark.sql import functions as F

from dataward.operators import actions, reports, validate
from dataward.operators.pii import lineage_tables
from dataward.plans.governance_run import governance_run, persist_run
from dataward.plans.quality_run import quality_run
from dataward.sources import sinks


def orders(spark, n=200):
    return spark.range(n).selectExpr(
        "id AS row_key", "CASE WHEN id = 50 THEN 49 ELSE id END AS order_id",
        "CASE WHEN id % 40 = 3 THEN NULL WHEN id % 40 = 4 THEN 'bad' "
        "ELSE concat('u', id, '@x.org') END AS email",
        "CASE WHEN id % 20 = 5 THEN -id ELSE id END AS order_amount",
        "CASE WHEN id % 50 = 9 THEN '2099-01-01' ELSE '2024-05-05' END AS order_date",
        "CASE WHEN id % 50 = 8 THEN 'oops' ELSE 'open' END AS status")


def test_quality_run_heals_a_generated_suite(spark):
    run = quality_run(orders(spark), "row_key", "orders", "2026-01-01")
    assert run.status == "PASS"
    rows = run.clean.count() + run.quarantined.count()
    dropped = run.history.where("action_type = 'deduplicate'").agg(
        F.coalesce(F.sum("rows_affected"), F.lit(0))).first()[0]
    assert rows + dropped == 200
    assert run.results.where("NOT success").count() == 0
    assert run.clean.where("order_amount < 0").count() == 0


def test_quality_run_alerts_when_nothing_helps(spark):
    rules = [{"expectation_type": "expect_column_values_to_be_of_type", "column_name": "status",
              "type_": "int"}]
    run = quality_run(orders(spark), "row_key", "orders", "2026-01-01", rules=rules)
    assert (run.status, run.cycles, run.clean.count()) == ("ALERT", 5, 200)
    message = reports.alert_message(run.results, run.profiles, run.history.select(
        "column_name", "confidence"), run.cycles).first()
    assert "MANUAL INTERVENTION REQUIRED." in message.message


def test_proposed_action_is_used(spark):
    rules = [{"expectation_type": "expect_column_values_to_be_in_set", "column_name": "status",
              "value_set": ["open", "closed"]}]
    proposed = spark.createDataFrame(
        [(1, "status", "in_set", "fix_value", "replace_invalid_categorical", None, None, None,
          ["?"], "closed", None, None, None)], actions.PROPOSAL_SCHEMA)
    run = quality_run(orders(spark), "row_key", "orders", "2026-01-01", rules=rules,
                      proposed_actions=proposed)
    assert run.status == "PASS"
    assert run.clean.where("status = 'closed'").count() == 4


def test_empty_column_passes(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k bigint, v string")
    rule = [{"expectation_type": "expect_column_values_to_not_be_null", "column_name": "v"}]
    assert not validate.validate(df, rule).first().success
    row = validate.validate(df, rule, skip_empty=True).first()
    assert row.success and "no values" in row.error


def test_missing_suite_and_no_rules(spark):
    assert validate.missing_suite(spark, "s").first().success is False
    df = spark.createDataFrame([(1,)], "k bigint")
    stats = validate.suite_statistics(validate.validate(df, [])).first()
    assert (stats.evaluated_expectations, stats.success_percent, stats.success) == (0, 0.0, True)


def test_failing_rows_of_unique_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")],
                               "k bigint, v string")
    rule = [{"expectation_type": "expect_column_values_to_be_unique", "column_name": "v"}]
    assert validate.validate(df, rule).first().failing_count == 4
    assert sorted(r.key for r in validate.failing_rows(df, rule, "k").collect()) == [1, 2, 3, 4]


def test_governance_run_and_second_load(spark):
    people = spark.range(40).selectExpr(
        "id", "concat('p', id, '@x.org') AS contact", "'A1234567' AS passport_no",
        "'plain' AS city_code")
    edges = spark.createDataFrame(
        [("people", "contact", "people_clean", "contact", "direct", 1),
         ("people", "contact", "people_clean", "contact", "upper", 2),
         ("missing", "x", "people_clean", "y", "direct", 3)],
        "src_table string, src_col string, tgt_table string, tgt_col string, "
        "transform string, edge_order bigint")
    run = governance_run({"people": people}, edges)
    found = {r.column_name: (r.pii_type, r.detection_method) for r in run.detections.collect()}
    assert found == {"contact": ("EMAIL", "semantic+regex"),
                     "passport_no": ("PASSPORT", "keyword+regex"),
                     "city_code": ("ADDRESS", "keyword")}
    assert run.masked["people"].first().passport_no == "A******7"
    first = persist_run(run, {}, "2026-01-01 00:00:00")
    second = persist_run(run, first, "2026-01-02 00:00:00")
    assert {n: t.count() for n, t in second.items()} == {
        "lineage_edges": 2, "catalog_tables": 1, "pii_tags": 3, "catalog_columns": 3,
        "governance_reports": 2}
    assert second["pii_tags"].select("created_at").distinct().count() == 1


def test_saved_tables_and_console(spark):
    df = orders(spark, 10)
    assert sinks.save_results(df, df.limit(2), "My Stress-Test.csv") == [
        "my_stress_test_clean", "my_stress_test_quarantine"]
    assert sinks.suite_name("My Data.csv") == "my_data_quality_suite"
    sinks.save_masked({"people": df.select("email")})
    counts = {r.table_name: r.row_count for r in reports.list_tables(spark).collect()
              if not r.table_name.startswith("console")}
    assert counts["my_stress_test_clean"] == 10 and counts["my_stress_test_quarantine"] == 2
    assert counts["people_masked"] == 10
    described = reports.console(spark, "PRAGMA table_info('people_masked');").collect()
    assert [r.col_name for r in described] == ["email"]
    assert reports.run_sql(spark, "SELECT * FROM my_stress_test_clean", 3)["row_count"] == 10
    edges = spark.createDataFrame([("people_masked", "nowhere")],
                                  "src_table string, tgt_table string")
    assert list(lineage_tables(spark, edges)) == ["people_masked"]
    sinks.save_table(df, "my_stress_test_clean", "append")
    assert spark.table("my_stress_test_clean").count() == 20
