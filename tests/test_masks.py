import pytest
from pyspark.sql import functions as F

from dataward.functions.masks import mask

CASES = [
    ("EMAIL", "john@gmail.com", "j***@gmail.com"), ("EMAIL", "j@x.org", "*@x.org"),
    ("EMAIL", "@x.org", "*@x.org"), ("EMAIL", "no at", "no at"),
    ("EMAIL", "ab@c@d.e", "a***@c@d.e"), ("EMAIL", None, None), ("EMAIL", "  ", "  "),
    ("PHONE", "9876543210", "******3210"), ("PHONE", "+1-555-0199", "****0199"),
    ("PHONE", "12", "****"),
    ("NAME", "John Doe", "J*** D**"), ("NAME", "Li", "L*"), ("NAME", " A  B Carter ", "* * C*****"),
    ("NAME", "a\tbc", "* b*"),
    ("ADDRESS", "123 Main St", "REDACTED"), ("ADDRESS", "", ""),
    ("AADHAAR", "1234 5678 9012", "XXXX XXXX 9012"), ("AADHAAR", "12", "XXXX XXXX XXXX"),
    ("PAN", "abcde1234f", "XXXXX1234X"), ("PAN", "ABC", "XXXXXXXXXX"),
    ("PASSPORT", "A1234567", "A******7"), ("PASSPORT", "A1", "**"),
    ("SSN", "123-45-6789", "***-**-6789"), ("SSN", "1", "***-**-****"),
    ("CREDIT_CARD", "4111111111111111", "************1111"),
    ("CREDIT_CARD", "x", "****************"),
    ("DOB", "1990-05-15", "1990-**-**"), ("DOB", "1990/5/1 10:00", "1990-**-**"),
    ("DOB", "15.05.1990", "****-**-**"),
    ("IP", "192.168.1.1", "192.168.*.*"), ("IP", "::1", "*.*.*.*"),
    ("SOMETHING", "secret", "s****t"), ("SOMETHING", "ab", "**"), ("SOMETHING", " x ", "*"),
]


@pytest.mark.parametrize("pii_type", sorted({c[0] for c in CASES}))
def test_mask(spark, pii_type):
    cases = [(i, v, e) for i, (t, v, e) in enumerate(CASES) if t == pii_type]
    df = spark.createDataFrame(cases, "i int, value string, expected string")
    got = df.select("i", "expected", mask(F.col("value"), pii_type).alias("got")).collect()
    assert {r.i: r.got for r in got} == {r.i: r.expected for r in got}
