"""Masking expressions: pure projections, one per kind of personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataward.functions.coerce import strip


def _stars(length: Column) -> Column:
    return F.repeat(F.lit("*"), length.cast("int"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def _ends_only(value: Column) -> Column:
    text = strip(value)
    n = F.length(text)
    return F.when(n <= 2, _stars(n)).otherwise(
        F.concat(F.left(text, F.lit(1)), _stars(n - 2), F.right(text, F.lit(1))))


def _last_four(value: Column, short: str, head) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return F.when(n < 4, F.lit(short)).otherwise(
        F.concat(head(n - 4), F.right(digits, F.lit(4))))


def _email(value: Column) -> Column:
    at = F.instr(value, "@")
    domain = F.substr(value, at)
    return (F.when(at == 0, value)
            .when(at <= 2, F.concat(F.lit("*"), domain))
            .otherwise(F.concat(F.left(value, F.lit(1)), F.lit("***"), domain)))


def _name(value: Column) -> Column:
    words = F.split(strip(value), r"(?U)\s+")
    return F.array_join(
        F.transform(words, lambda w: F.when(F.length(w) <= 1, F.lit("*")).otherwise(
            F.concat(F.left(w, F.lit(1)), _stars(F.length(w) - 1)))),
        " ")


def _pan(value: Column) -> Column:
    text = F.upper(strip(value))
    return F.when(F.length(text) == 10,
                  F.concat(F.lit("XXXXX"), F.substr(text, F.lit(6), F.lit(4)), F.lit("X"))
                  ).otherwise(F.lit("XXXXXXXXXX"))


def _dob(value: Column) -> Column:
    text = strip(value)
    return F.when(text.rlike(r"(?U)^\d{4}[-/]\d{1,2}[-/]\d{1,2}"),
                  F.concat(F.left(text, F.lit(4)), F.lit("-**-**"))
                  ).otherwise(F.lit("****-**-**"))


def _ip(value: Column) -> Column:
    parts = F.split(strip(value), r"\.")
    return F.when(F.size(parts) == 4,
                  F.concat(parts[0], F.lit("."), parts[1], F.lit(".*.*"))
                  ).otherwise(F.lit("*.*.*.*"))


def _fixed(text: str):
    return lambda n: F.lit(text)


MASKS = {
    "EMAIL": _email,
    "PHONE": lambda v: _last_four(v, "****", _stars),
    "NAME": _name,
    "ADDRESS": lambda v: F.lit("REDACTED"),
    "AADHAAR": lambda v: _last_four(v, "XXXX XXXX XXXX", _fixed("XXXX XXXX ")),
    "PAN": _pan,
    "PASSPORT": _ends_only,
    "SSN": lambda v: _last_four(v, "***-**-****", _fixed("***-**-")),
    "CREDIT_CARD": lambda v: _last_four(v, "****************", _stars),
    "DOB": _dob,
    "IP": _ip,
}


def mask(value: Column, pii_type: str) -> Column:
    """Masked text; null and blank values pass through. Unknown types keep the ends."""
    text = value.cast("string")
    masked = MASKS.get(pii_type, _ends_only)(text)
    return F.when(text.isNull() | (strip(text) == ""), text).otherwise(masked)
