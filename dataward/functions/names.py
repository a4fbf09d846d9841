"""Decisions taken from a column's name alone."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataward.constants import (
    PII_EXCLUSIONS,
    PII_KEYWORDS,
    SIGNED_NAMES,
    UNSIGNED_NAMES,
)


def any_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(w).replace(r"\-", "-") for w in words)


def contains_any(name: Column, words: Iterable[str]) -> Column:
    return F.lower(name).rlike(any_of(words))


def abs_is_safe(name: Column) -> Column:
    """Negative values are errors: an unsigned word and no signed word in the name."""
    return ~contains_any(name, SIGNED_NAMES) & contains_any(name, UNSIGNED_NAMES)


# The same test on the column column_name of a metadata table, as SQL.
ABS_IS_SAFE = (f"(NOT lower(column_name) RLIKE '{any_of(SIGNED_NAMES)}' "
               f"AND lower(column_name) RLIKE '{any_of(UNSIGNED_NAMES)}')")


def pii_type_of_name(name: Column) -> Column:
    """First type with a keyword that equals, prefixes or suffixes the name as a word,
    or, from four letters on, occurs anywhere in it."""
    lower = F.lower(F.trim(name))
    chain = F.when(lower.isin(PII_EXCLUSIONS), F.lit(None).cast("string"))
    for pii_type, words in PII_KEYWORDS.items():
        anywhere = [w for w in words if len(w) >= 4]
        hit = lower.rlike(f"(^|_)({any_of(words)})$") | lower.rlike(f"^({any_of(words)})_")
        if anywhere:
            hit = hit | lower.rlike(any_of(anywhere))
        chain = chain.when(hit, F.lit(pii_type))
    return chain
