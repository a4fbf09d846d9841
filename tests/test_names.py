from pyspark.sql import functions as F

from dataward.constants import PII_EXCLUSIONS, PII_KEYWORDS
from dataward.functions.names import abs_is_safe, pii_type_of_name
from dataward.operators import rules

NAMES = ["email", "Email_Home", "mail", "cellar", "cell", "uid", "fluid", "guid_x", "x_uid", "pan",
         "span", "pan_no", "company", "ip_address", "client_ip", "dob", "adobe", "zip", "unzip",
         "zipcode", "ssn", "ssn_last", "product_name", "product_names", " name ", "credit_card_x",
         "street", "capacity", "x-mail", "e-mail", "telephone", "location", "address2"]


def expected(name):
    lower = name.lower().strip()
    if lower in PII_EXCLUSIONS:
        return None
    for pii_type, words in PII_KEYWORDS.items():
        for w in words:
            if (w == lower or lower.endswith("_" + w) or lower.startswith(w + "_")
                    or (len(w) >= 4 and w in lower)):
                return pii_type
    return None


def test_pii_type_of_name(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n: r.t for r in df.select("n", pii_type_of_name(F.col("n")).alias("t")).collect()}
    assert got == {n: expected(n) for n in NAMES}


def test_abs_is_safe(spark):
    cases = {"order_amount": True, "balance": False, "total_balance": False, "quantity": True,
             "temperature": False, "Age": True, "score": False, "return_amount": False}
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    got = {r.n: r.s for r in df.select("n", abs_is_safe(F.col("n")).alias("s")).collect()}
    assert got == cases


def test_canonical_type(spark):
    df = spark.createDataFrame([("no_nulls",), ("odd",), (None,)], "t string")
    got = [r.c for r in df.select(rules.canonical_type(F.col("t")).alias("c")).collect()]
    assert got == ["expect_column_values_to_not_be_null", "odd", None]


def test_negative_only_column_keeps_its_bound(spark):
    row = spark.createDataFrame(
        [("d", "depth", 0, "float", 10, 0, 0.0, 10, 100.0, -9.0, -3.0, 10, "float")],
        "dataset string, column_name string, ordinal int, dtype string, total_count bigint, "
        "null_count bigint, null_pct double, unique_count bigint, unique_pct double, "
        "min_value double, max_value double, negative_count bigint, semantic_type string"
    ).withColumn("category_values", F.lit(None).cast("array<struct<value:string,n:bigint>>"))
    between = [r for r in rules.generate_rules(row).collect()
               if r.expectation_type.endswith("between")]
    assert [(r.min_value, r.max_value) for r in between] == [("-9.0", "-3.0")]
