"""Profiles, semantic types, scores and generated rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataward.constants import EMAIL_REGEX
from dataward.operators import classify, profile, rules
from queries.fixtures import AS_OF, VIEWS, oracle, table, written_dates
from queries.registry import query
from queries.sqlparts import ABS_SAFE, HEALTH, SEMANTIC, profile_sql


def profiles(spark, sf, *names, **options) -> DataFrame:
    return profile.profile_tables({n: table(spark, sf, n) for n in names}, AS_OF, **options)


def profile_oracle(select: str, *names: str, where: str = "", more=None) -> str:
    views = [n for n in names if n in VIEWS]
    return oracle(f"{select} FROM p {where}", *views,
                  ctes={"p": profile_sql(*names)} | (more or {}))


NUMERIC = ["dataset", "column_name", "dtype", "total_count", "null_count", "unique_count",
           "unique_pct", "min_value", "max_value", "mean", "std", "p25", "p75",
           "negative_count", "zero_count"]
IS_NUMERIC = "WHERE dtype IN ('int', 'float')"


@query("profile_numeric", profile_oracle(
    "SELECT " + ", ".join(NUMERIC), "lineitem", "orders", where=IS_NUMERIC))
def profile_numeric(spark, sf):
    return profiles(spark, sf, "lineitem", "orders").where(
        F.col("dtype").isin("int", "float")).select(NUMERIC)


@query("profile_quantiles_refined", profile_oracle(
    "SELECT dataset, column_name, unique_count, p25, p75", "lineitem", "events",
    where=IS_NUMERIC))
def profile_quantiles_refined(spark, sf):
    """Same quartiles through the rank search used beyond one group's size."""
    return profiles(spark, sf, "lineitem", "events", group_limit=500).where(
        F.col("dtype").isin("int", "float")).select(
        "dataset", "column_name", "unique_count", "p25", "p75")


SKETCHED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


@query("profile_sketched", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS total_count, true AS distinct_close, true AS quartiles_close "
    "FROM lineitem" for c in SKETCHED))
def profile_sketched(spark, sf):
    """Mergeable sketches instead of exact distinct counts and quartiles: distinct counts
    within 15 %, quartiles within 1 % of the value range."""
    near = profiles(spark, sf, "lineitem", approx=True).alias("a")
    exact = profiles(spark, sf, "lineitem").alias("e")
    span = F.col("e.max_value") - F.col("e.min_value")
    quartiles = [F.abs(F.col(f"a.{q}") - F.col(f"e.{q}")) <= 0.01 * span for q in ("p25", "p75")]
    return (near.join(exact, "column_name").where(F.col("column_name").isin(SKETCHED)).select(
        "column_name", F.col("a.total_count").alias("total_count"),
        (F.abs(F.col("a.unique_count") - F.col("e.unique_count")) <= 0.15 * F.col("e.unique_count"))
        .alias("distinct_close"),
        F.coalesce(quartiles[0] & quartiles[1], F.lit(True)).alias("quartiles_close")))


@query("profile_sampled", """
SELECT 'l_quantity' AS column_name, count(*) > 2000 AS sampled, count(*) AS total_rows, true AS size_close,
 true AS mean_close FROM lineitem""")
def profile_sampled(spark, sf):
    """A Bernoulli sample: all rows known, its size within 15 % of the one asked for, the mean
    within 10 %."""
    row = profiles(spark, sf, "lineitem", sample_rows=2_000).where("column_name = 'l_quantity'")
    whole = table(spark, sf, "lineitem").agg(F.avg("l_quantity").alias("m"))
    return row.select("column_name", "sampled", "total_rows",
                      F.col("profiled_rows").between(1_700, 2_300).alias("size_close"),
                      (F.abs(F.col("mean") / whole.scalar() - 1) < 0.1).alias("mean_close"))


DATES = ["dataset", "column_name", "total_count", "null_count", "null_pct", "unique_count",
         "min_date", "max_date", "future_date_count", "future_date_pct"]


@query("profile_datetime", profile_oracle(
    "SELECT " + ", ".join(DATES), "dirty_orders", "dirty_patients", "lineitem", "events",
    where="WHERE dtype = 'datetime'"))
def profile_datetime(spark, sf):
    return profiles(spark, sf, "dirty_orders", "dirty_patients", "lineitem", "events").where(
        F.col("dtype") == "datetime").select(DATES)


TEXTS = ["dataset", "column_name", "null_count", "null_pct", "unique_count", "unique_pct",
         "has_empty_strings", "valid_email_count", "invalid_email_count"]


@query("profile_strings", profile_oracle(
    "SELECT " + ", ".join(TEXTS) + ", array_to_string(top, '|') AS top_values",
    "orders", "customer", "dirty_orders", "dirty_patients", where="WHERE dtype = 'object'"))
def profile_strings(spark, sf):
    return profiles(spark, sf, "orders", "customer", "dirty_orders", "dirty_patients").where(
        F.col("dtype") == "object").select(*TEXTS, F.array_join(
            F.transform("top_values", lambda t: t["value"]), "|").alias("top_values"))


@query("profile_long_text", """
WITH long_values AS (
 SELECT 'documents' AS dataset, 'text' AS column_name, text AS v FROM documents
 UNION ALL SELECT 'documents', 'lang', lang FROM documents
 UNION ALL SELECT 'documents', 'source', source FROM documents
 UNION ALL SELECT 'pages', 'url', url FROM pages
 UNION ALL SELECT 'pages', 'html', html FROM pages),
counted AS (
 SELECT dataset, column_name, v, count(*) AS n,
  sha256(v) AS k
 FROM long_values GROUP BY ALL),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY dataset, column_name ORDER BY n DESC, k) AS r,
  count(*) OVER (PARTITION BY dataset, column_name) AS unique_count FROM counted)
SELECT dataset, column_name, unique_count, r AS rank, sha256(v) AS digest, n
FROM ranked WHERE r <= 10""")
def profile_long_text(spark, sf):
    """Distinct counts and top values of whole documents, which never enter a shuffle."""
    found = profiles(spark, sf, "documents", "pages").where(F.col("dtype") == "object")
    return found.select("dataset", "column_name", "unique_count",
                        F.posexplode("top_values").alias("place", "t")).select(
        "dataset", "column_name", "unique_count",
        (F.col("place") + 1).cast("bigint").alias("rank"),
        F.sha2("t.value", 256).alias("digest"), F.col("t.n").alias("n"))


SAMPLED = ["customer_name", "email", "product", "order_date", "status"]


@query("sample_values", oracle(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY row_key) AS rank,"
    f" {c} AS value FROM dirty_orders WHERE {c} IS NOT NULL) WHERE rank <= 3"
    for c in SAMPLED), "dirty_orders"))
def sample_values(spark, sf):
    return profile.sample_values(table(spark, sf, "dirty_orders"), "row_key").withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("dataset_info", oracle("""
SELECT 'dirty_orders' AS dataset, count(*) AS row_count, cast(10 AS bigint) AS column_count,
 'row_key,order_id,customer_id,customer_name,email,product,quantity,order_amount,order_date,status' AS columns,
 'row_key:int,order_id:int,customer_id:int,customer_name:object,email:object,product:object,quantity:int,order_amount:float,order_date:object,status:object' AS dtypes,
 (SELECT array_to_string(list(row_key ORDER BY row_key), ',') FROM
  (SELECT row_key FROM dirty_orders ORDER BY row_key LIMIT 3)) AS first_rows
FROM dirty_orders""", "dirty_orders"))
def dataset_info(spark, sf):
    info = profile.dataset_info(table(spark, sf, "dirty_orders"), "dirty_orders", "row_key")
    return info.withColumn("first_rows", F.array_join(F.transform(
        "sample_rows", lambda r: F.get_json_object(r, "$.row_key")), ",")).drop("sample_rows")


@query("dataset_null_rate", profile_oracle(
    "SELECT dataset, cast(sum(null_count) AS bigint) AS null_cells, "
    "cast(sum(total_count) AS bigint) AS cells, "
    "round(sum(null_count) / sum(total_count) * 100, 4) AS null_rate_pct",
    "dirty_orders", "dirty_patients", where="GROUP BY dataset"))
def dataset_null_rate(spark, sf):
    return profile.null_rate(profiles(spark, sf, "dirty_orders", "dirty_patients"))


FLEET = ["orders", "lineitem", "events", "customer", "part", "documents", "dirty_orders",
         "dirty_patients", "customer_pii"]


@query("semantic_types", profile_oracle(
    f"SELECT dataset, column_name, dtype, {SEMANTIC} AS semantic_type", *FLEET))
def semantic_types(spark, sf):
    return classify.with_semantic_types(profiles(spark, sf, *FLEET)).select(
        "dataset", "column_name", "dtype", "semantic_type")


ISSUES = """concat_ws('; ',
 CASE WHEN null_pct > 5 THEN cast(null_pct AS varchar) || '% null values' END,
 CASE WHEN negative_count > 0 THEN cast(negative_count AS varchar) || ' negative values' END,
 CASE WHEN future_date_pct > 0 THEN cast(future_date_pct AS varchar) || '% future dates' END,
 CASE WHEN invalid_email_count > 0 THEN cast(invalid_email_count AS varchar) || ' invalid email addresses' END,
 CASE WHEN has_empty_strings > 0 THEN cast(has_empty_strings AS varchar) || ' empty strings' END)"""


@query("column_health", profile_oracle(
    f"SELECT dataset, column_name, {HEALTH} AS health_status, {ISSUES} AS issues",
    "dirty_orders", "dirty_patients", "customer"))
def column_health(spark, sf):
    return classify.column_health(
        profiles(spark, sf, "dirty_orders", "dirty_patients", "customer")).select(
        "dataset", "column_name", "health_status", F.array_join("issues", "; ").alias("issues"))


@query("quality_score", profile_oracle(
    "SELECT dataset, count(*) AS columns, cast(greatest(0, floor(100 - round(avg("
    "least(null_pct / 100, 0.3) + CASE WHEN negative_count > 0 THEN 0.1 ELSE 0 END "
    "+ CASE WHEN future_date_pct > 0 THEN 0.2 ELSE 0 END) * 100, 9))) AS bigint) "
    "AS quality_score", "dirty_orders", "dirty_patients", "customer",
    where="GROUP BY dataset"))
def quality_score(spark, sf):
    return classify.quality_score(
        profiles(spark, sf, "dirty_orders", "dirty_patients", "customer"))


@query("column_priority", oracle("""
SELECT dataset, column_name, is_priority, row_number() OVER (
 PARTITION BY dataset ORDER BY is_priority DESC, ordinal) AS priority_rank
FROM (SELECT *, health IN ('CRITICAL', 'WARNING') OR semantic_type IN
 ('email', 'currency', 'datetime', 'categorical', 'identifier') AS is_priority FROM typed)""",
    "dirty_orders", "dirty_patients", ctes={
        "p": profile_sql("dirty_orders", "dirty_patients", "lineitem"),
        "typed": f"SELECT *, {SEMANTIC} AS semantic_type, {HEALTH} AS health FROM p"}))
def column_priority(spark, sf):
    return classify.column_priority(
        profiles(spark, sf, "dirty_orders", "dirty_patients", "lineitem")).select(
        "dataset", "column_name", "is_priority",
        F.col("priority_rank").cast("bigint").alias("priority_rank"))


# ---- rules ------------------------------------------------------------------

RULED = ["dirty_orders", "dirty_patients", "lineitem"]
IS_NUMBER = ("semantic_type IN ('currency', 'integer', 'float') AND min_value IS NOT NULL")
GENERATED = f"""
SELECT dataset, column_name, 'expect_column_values_to_not_be_null' AS expectation_type,
 NULL::double AS min_number, NULL::double AS max_number, NULL AS bounds, NULL AS value_set,
 NULL AS regex FROM typed WHERE null_pct < 5 OR semantic_type = 'email'
UNION ALL SELECT dataset, column_name, 'expect_column_values_to_be_unique',
 NULL, NULL, NULL, NULL, NULL FROM typed WHERE semantic_type = 'identifier'
UNION ALL SELECT dataset, column_name, 'expect_column_values_to_be_between',
 CASE WHEN negative_count > 0 AND {ABS_SAFE} THEN 0.0 ELSE least(0.0, min_value) END,
 CASE WHEN max_value < 0 THEN max_value ELSE round(max_value * 1.5, 4) END, NULL, NULL, NULL
 FROM typed WHERE {IS_NUMBER}
UNION ALL SELECT dataset, column_name, 'expect_column_values_to_be_between',
 NULL, NULL, '1900-01-01..today', NULL, NULL FROM typed WHERE semantic_type = 'datetime'
UNION ALL SELECT dataset, column_name, 'expect_column_values_to_be_in_set',
 NULL, NULL, NULL, array_to_string(cats, '|'), NULL FROM typed
 WHERE semantic_type = 'categorical' AND len(cats) > 0
UNION ALL SELECT dataset, column_name, 'expect_column_values_to_match_regex',
 NULL, NULL, NULL, NULL, '{EMAIL_REGEX}' FROM typed WHERE semantic_type = 'email'"""
RULE_OUT = ["dataset", "column_name", "expectation_type", "min_number", "max_number", "bounds",
            "value_set", "regex"]


def typed_cte(*names: str) -> dict[str, str]:
    return {"p": profile_sql(*names),
            "typed": f"SELECT *, {SEMANTIC} AS semantic_type FROM p"}


def comparable(suite: DataFrame, *more: str) -> DataFrame:
    """Rules with numeric bounds as numbers and others as one text."""
    low, high = F.col("min_value").try_cast("double"), F.col("max_value").try_cast("double")
    return suite.select(
        "dataset", "column_name", "expectation_type", low.alias("min_number"),
        high.alias("max_number"),
        F.when(low.isNull() & F.col("min_value").isNotNull(),
               F.concat_ws("..", "min_value", "max_value")).alias("bounds"),
        F.array_join("value_set", "|").alias("value_set"), "regex", *more)


@query("suggest_rules", oracle(
    "SELECT " + ", ".join(RULE_OUT) + f" FROM ({GENERATED})",
    "dirty_orders", "dirty_patients", ctes=typed_cte(*RULED)))
def suggest_rules(spark, sf):
    typed = classify.settled(classify.with_semantic_types(
        profiles(spark, sf, *RULED)))
    return comparable(rules.build_suite(typed))


# One proposal per way a user's rule is dropped or repaired.
PROPOSED = [
    # order, dataset, type, column, min, max, set, regex, reasoning
    (1, "dirty_orders", "not_null", "no_such_column", None, None, None, None, "dropped"),
    (2, "dirty_orders", "no_nulls", "email", None, None, None, None, "synonym"),
    (3, "dirty_orders", "expect_magic", "email", None, None, None, None, "dropped"),
    (4, "dirty_orders", "within_range", "order_amount", None, None, None, None, "fill"),
    (5, "dirty_orders", "in_set", "quantity", None, None, ["1", "2"], None, "to range"),
    (6, "dirty_orders", "in_set", "status", None, None, [], None, "fill set"),
    (7, "dirty_orders", "match_regex", "product", None, None, None, "^[A-Z]", "to set"),
    (8, "dirty_orders", "match_regex", "email", None, None, None, "^.+$", "standard"),
    (9, "dirty_orders", "is_unique", "order_id", None, None, None, None, ""),
    (10, "dirty_orders", "unique", "order_id", None, None, None, None, "repeated"),
    (11, "dirty_orders", "before_or_equal_to", "order_date", None, None, None, None, "dates"),
    (12, "dirty_orders", "within_range", "quantity", "2", None, None, None, "half open"),
    (13, "dirty_orders", "in_set", "customer_id", None, None, [], None, "to range"),
    (14, "dirty_patients", "in_set", "phone", None, None, ["x"], None, "kept"),
    (15, "dirty_patients", "expect_column_values_to_be_of_type", "age", None, None, None,
     None, None),
    (16, "dirty_patients", "match_regex", "department", None, None, None, "^C", "to set"),
]


def proposals(spark) -> DataFrame:
    rows = [(d, o, t, c, lo, hi, s, r, None, why) for o, d, t, c, lo, hi, s, r, why in PROPOSED]
    return spark.createDataFrame(rows, rules.RULE_SCHEMA)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(_literal(v) for v in value) + "]::varchar[]"
    return f"'{value}'" if isinstance(value, str) else str(value)


PROPOSED_SQL = (
    "SELECT * FROM (VALUES " + ", ".join(
        "(" + ", ".join(_literal(v) for v in row) + ")" for row in PROPOSED)
    + ") t(rule_order, dataset, given, column_name, min_value, max_value, value_set, regex,"
      " reasoning)")
CANONICAL = """CASE
 WHEN given IN ('within_range', 'before_or_equal_to') THEN 'expect_column_values_to_be_between'
 WHEN given IN ('unique', 'is_unique') THEN 'expect_column_values_to_be_unique'
 WHEN given IN ('not_null', 'no_nulls') THEN 'expect_column_values_to_not_be_null'
 WHEN given = 'in_set' THEN 'expect_column_values_to_be_in_set'
 WHEN given IN ('match_regex', 'expect_column_values_to_be_valid_email') THEN 'expect_column_values_to_match_regex'
 ELSE given END"""
SANITIZED = f"""
SELECT cast(rule_order AS bigint) AS rule_order, dataset, column_name, final AS expectation_type,
 CASE WHEN date_range OR NOT number_range THEN try_cast(min_value AS double)
  WHEN min_value IS NULL THEN least(0.0, seen_min) ELSE try_cast(min_value AS double) END AS min_number,
 CASE WHEN date_range OR NOT number_range THEN try_cast(max_value AS double)
  WHEN max_value IS NULL THEN CASE WHEN seen_max < 0 THEN seen_max ELSE round(seen_max * 1.5, 4) END ELSE try_cast(max_value AS double) END AS max_number,
 CASE WHEN date_range THEN coalesce(min_value, '1900-01-01') || '..' || coalesce(max_value, 'today') END AS bounds,
 CASE WHEN final = 'expect_column_values_to_be_in_set' AND (wanted <> final OR coalesce(len(value_set), 0) = 0)
  THEN array_to_string(cats, '|')
  WHEN number_range THEN NULL ELSE array_to_string(value_set, '|') END AS value_set,
 CASE WHEN final = 'expect_column_values_to_match_regex' AND semantic_type = 'email' THEN '{EMAIL_REGEX}'
  WHEN wanted = final THEN regex END AS regex,
 CASE WHEN coalesce(reasoning, '') <> '' THEN reasoning ELSE 'Auto-generated rule for ''' || column_name
  || ''' (semantic type: ' || semantic_type || ', check: ' || final || ')' END AS reasoning
FROM (SELECT *, CASE
  WHEN wanted = 'expect_column_values_to_be_in_set' AND is_number THEN 'expect_column_values_to_be_between'
  WHEN wanted = 'expect_column_values_to_match_regex' AND semantic_type = 'categorical' THEN 'expect_column_values_to_be_in_set'
  ELSE wanted END AS final,
  wanted = 'expect_column_values_to_be_between' AND semantic_type = 'datetime' AS date_range,
  is_number AND wanted IN ('expect_column_values_to_be_between', 'expect_column_values_to_be_in_set') AS number_range
 FROM (SELECT q.*, {CANONICAL} AS wanted, t.semantic_type, t.cats, t.min_value AS seen_min,
   t.max_value AS seen_max, t.semantic_type IN ('currency', 'integer', 'float') AS is_number
  FROM proposed q JOIN typed t USING (dataset, column_name)))
WHERE starts_with(final, 'expect_column_values_to_')"""


@query("sanitize_rules", oracle(
    f"SELECT * FROM ({SANITIZED})", "dirty_orders", "dirty_patients",
    ctes=typed_cte("dirty_orders", "dirty_patients") | {"proposed": PROPOSED_SQL}))
def sanitize_rules(spark, sf):
    typed = classify.settled(classify.with_semantic_types(
        profiles(spark, sf, "dirty_orders", "dirty_patients")))
    clean = rules.sanitize_rules(proposals(spark), typed)
    return comparable(clean, "rule_order", "reasoning")


@query("build_suite", oracle(f"""
SELECT {", ".join(RULE_OUT)} FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset, column_name, expectation_type ORDER BY o) AS place
 FROM (SELECT rule_order AS o, {", ".join(RULE_OUT)} FROM ({SANITIZED})
  UNION ALL SELECT 1000000 AS o, {", ".join(RULE_OUT)} FROM ({GENERATED})))
WHERE place = 1""", "dirty_orders", "dirty_patients",
    ctes=typed_cte("dirty_orders", "dirty_patients") | {"proposed": PROPOSED_SQL}))
def build_suite(spark, sf):
    typed = classify.settled(classify.with_semantic_types(
        profiles(spark, sf, "dirty_orders", "dirty_patients")))
    return comparable(rules.build_suite(typed, proposals(spark)))


WIDE = """SELECT o_orderkey AS row_key, n_name AS nation FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def wide(spark, sf):
    """Orders with one of 25 nations."""
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(
        table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).selectExpr(
        "o_orderkey AS row_key", "n_name AS nation")


@query("suggest_rules_wide_category", f"""
SELECT 'expect_column_values_to_be_in_set' AS expectation_type,
 (SELECT string_agg(nation, '|' ORDER BY nation) FROM (SELECT DISTINCT nation FROM ({WIDE}))) AS value_set""")
def suggest_rules_wide_category(spark, sf):
    """All values of a category, not the most frequent ones."""
    typed = classify.settled(classify.with_semantic_types(profile.profile(wide(spark, sf), "wide", AS_OF)))
    return rules.build_suite(typed).where(F.col("column_name") == "nation").where(
        F.col("value_set").isNotNull()).select(
        "expectation_type", F.array_join(F.array_sort("value_set"), "|").alias("value_set"))


@query("profile_ties_long_text", """
WITH t AS (SELECT repeat(n_name, 1 + n_nationkey % 25 * 2) AS v FROM nation)
SELECT row_number() OVER (ORDER BY sha256(v)) AS rank, sha256(v) AS digest FROM t
QUALIFY row_number() OVER (ORDER BY sha256(v)) <= 10""")
def profile_ties_long_text(spark, sf):
    """Values of equal frequency below and above the length from which digests are grouped."""
    df = table(spark, sf, "nation").selectExpr("repeat(n_name, cast(1 + n_nationkey % 25 * 2 AS int)) AS v")
    return profile.profile(df, "ties", AS_OF).select(F.posexplode("top_values").alias("place", "t")).select(
        (F.col("place") + 1).cast("bigint").alias("rank"), F.sha2("t.value", 256).alias("digest"))


@query("profile_decimal", """
SELECT count(DISTINCT o_orderkey) AS unique_count FROM orders""")
def profile_decimal(spark, sf):
    """Decimals that are equal as doubles are still different values."""
    df = table(spark, sf, "orders").selectExpr(
        "cast(123456789012345678901.00 AS decimal(30, 2)) + cast(o_orderkey AS decimal(18, 2)) / 100 AS d")
    return profile.profile(df, "decimals", AS_OF).select("unique_count")


@query("sanitize_negative_max", """
SELECT 'expect_column_values_to_be_between' AS expectation_type, max(-o_totalprice) AS max_number FROM orders""")
def sanitize_negative_max(spark, sf):
    """The bound filled in for a column of negative numbers is its maximum."""
    df = table(spark, sf, "orders").selectExpr("-o_totalprice AS change")
    typed = classify.settled(classify.with_semantic_types(profile.profile(df, "d", AS_OF)))
    asked = spark.createDataFrame(
        [("d", 1, "within_range", "change", None, None, None, None, None, "x")], rules.RULE_SCHEMA)
    return rules.sanitize_rules(asked, typed).select(
        "expectation_type", F.col("max_value").cast("double").alias("max_number"))


@query("profile_month_names", """
SELECT c AS column_name, 'datetime' AS dtype, 0::BIGINT AS null_count, n_days AS unique_count,
 strftime(low, '%Y-%m-%d %H:%M:%S') AS min_date, strftime(high, '%Y-%m-%d %H:%M:%S') AS max_date
FROM (VALUES ('named_date'), ('long_date'), ('compact_date'), ('dotted_date'), ('month_date')) t(c),
 (SELECT count(DISTINCT o_orderdate::DATE) AS n_days, min(o_orderdate)::DATE::TIMESTAMP AS low,
         max(o_orderdate)::DATE::TIMESTAMP AS high FROM orders)""")
def profile_month_names(spark, sf):
    """Bounds and distinct counts of date columns written with names, without separators, with
    dots, and months first."""
    return (profile.profile(written_dates(spark, sf), as_of=AS_OF)
            .where(F.col("column_name").isin("named_date", "long_date", "compact_date", "dotted_date", "month_date"))
            .select("column_name", "dtype", "null_count", "unique_count", "min_date", "max_date"))
