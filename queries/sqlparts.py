"""SQL fragments for the check engine: profile, semantic type, coercion."""

from __future__ import annotations

from dataward.constants import (
    BOOLEAN_WORDS,
    CURRENCY_NAMES,
    DATETIME_NAMES,
    EMAIL_NAMES,
    ID_SUFFIXES,
    NA_TOKENS,
    PHONE_NAMES,
    SIGNED_NAMES,
    UNSIGNED_NAMES,
    URL_NAMES,
)
from dataward.functions.coerce import NUMBER_TEXT, TIME_TEXT
from queries.fixtures import AS_OF

NA = ", ".join(f"'{t}'" for t in NA_TOKENS)
NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"

# Columns of the inputs with their profile type.
COLUMNS = {
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "object"),
               ("o_totalprice", "float"), ("o_orderdate", "datetime"),
               ("o_orderpriority", "object")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"),
                 ("l_linenumber", "int"), ("l_quantity", "float"),
                 ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"),
                 ("l_returnflag", "object"), ("l_linestatus", "object"),
                 ("l_shipdate", "datetime")],
    "events": [("event_id", "int"), ("ts", "datetime"), ("user_id", "int"),
               ("event_type", "object"), ("value", "float"), ("props", "object")],
    "customer": [("c_custkey", "int"), ("c_name", "object"), ("c_nationkey", "int"),
                 ("c_acctbal", "float"), ("c_mktsegment", "object")],
    "part": [("p_partkey", "int"), ("p_name", "object"), ("p_brand", "object"),
             ("p_type", "object"), ("p_size", "int"), ("p_retailprice", "float")],
    "documents": [("doc_id", "int"), ("text", "object"), ("lang", "object"),
                  ("source", "object"), ("n_chars", "int")],
    "dirty_orders": [("row_key", "int"), ("order_id", "int"), ("customer_id", "int"),
                     ("customer_name", "object"), ("email", "object"),
                     ("product", "object"), ("quantity", "int"), ("order_amount", "float"),
                     ("order_date", "parsed"), ("status", "object")],
    "dirty_patients": [("row_key", "int"), ("patient_id", "object"), ("email", "object"),
                       ("phone", "object"), ("age", "object"), ("admission_date", "parsed"),
                       ("department", "object"), ("total_cost", "object"),
                       ("discharge_status", "object")],
    "customer_pii": [("row_key", "int")] + [(c, "object") for c in (
        "email", "phone_number", "full_name", "home_address", "aadhaar_number",
        "pan_number", "passport_no", "ssn", "card_number", "dob", "client_ip",
        "ip_address", "product_name", "handle", "signup_day")],
}


def safe_double(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER_TEXT}') THEN try_cast(trim({c}) AS double) END"


def safe_ts(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{TIME_TEXT}') THEN try_cast({c} AS timestamp) END"


def profile_sql(*datasets: str) -> str:
    """One row per column, in the layout of the profile table (top values as a list)."""
    rows = []
    for ds in datasets:
        for i, (name, kind) in enumerate(COLUMNS[ds]):
            rows.append(_column_sql(ds, i, name, kind))
    return "\nUNION ALL\n".join(rows)


def _column_sql(ds: str, ordinal: int, name: str, kind: str) -> str:
    value = safe_ts(name) if kind == "parsed" else name
    kind = "datetime" if kind == "parsed" else kind
    number, moment, text = kind in ("int", "float"), kind == "datetime", kind == "object"
    mail = text and "mail" in name

    def given(test, sql, sql_type):
        return f"cast({sql if test else 'NULL'} AS {sql_type})"

    def most(k: int) -> str:
        return (f"(SELECT list(t ORDER BY n DESC, sha256(t)) FROM (SELECT {name} AS t, count(*) AS n "
                f"FROM {ds} WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY n DESC, sha256(t) LIMIT {k}))"
                if text else "NULL::varchar[]")

    top, cats = most(10), f"CASE WHEN count(DISTINCT v) <= 50 THEN {most(50)} END"
    return f"""SELECT '{ds}' AS dataset, '{name}' AS column_name, {ordinal} AS ordinal,
 '{kind}' AS dtype, count(*) AS total_count, count(*) - count(v) AS null_count,
 round((count(*) - count(v)) / count(*) * 100, 2) AS null_pct,
 count(DISTINCT v) AS unique_count, round(count(DISTINCT v) / count(*) * 100, 2) AS unique_pct,
 {given(number, 'min(v)', 'double')} AS min_value,
 {given(number, 'max(v)', 'double')} AS max_value,
 {given(number, 'round(avg(v), 4)', 'double')} AS mean,
 {given(number, 'round(stddev_samp(v), 4)', 'double')} AS std,
 {given(number, 'round(quantile_cont(cast(v AS double), 0.25), 4)' , 'double')} AS p25,
 {given(number, 'round(quantile_cont(cast(v AS double), 0.75), 4)' , 'double')} AS p75,
 {given(number, 'count(*) FILTER (v < 0)', 'bigint')} AS negative_count,
 {given(number, 'count(*) FILTER (v = 0)', 'bigint')} AS zero_count,
 {given(moment, "strftime(min(v), '%Y-%m-%d %H:%M:%S')", 'varchar')} AS min_date,
 {given(moment, "strftime(max(v), '%Y-%m-%d %H:%M:%S')", 'varchar')} AS max_date,
 {given(moment, f'count(*) FILTER (v > {NOW})', 'bigint')} AS future_date_count,
 {given(moment, f'round(count(*) FILTER (v > {NOW}) / count(v) * 100, 2)', 'double')} AS future_date_pct,
 {given(text, "count(*) FILTER (v = '')", 'bigint')} AS has_empty_strings,
 {given(mail, "count(*) FILTER (regexp_matches(v, '@.*\\.'))", 'bigint')} AS valid_email_count,
 {given(mail, "count(*) FILTER (NOT regexp_matches(v, '@.*\\.'))", 'bigint')} AS invalid_email_count,
 {top} AS top, {cats} AS cats
FROM (SELECT {value} AS v FROM {ds})"""


def _any(words: list[str]) -> str:
    return "|".join(words)


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


SEMANTIC = f"""CASE
 WHEN coalesce(valid_email_count, 0) > 0 OR regexp_matches(lower(column_name), '{_any(EMAIL_NAMES)}') THEN 'email'
 WHEN regexp_matches(lower(column_name), '{_any(URL_NAMES)}') THEN 'url'
 WHEN regexp_matches(lower(column_name), '{_any(PHONE_NAMES)}') THEN 'phone'
 WHEN dtype = 'datetime' OR regexp_matches(lower(column_name), '{_any(DATETIME_NAMES)}') THEN 'datetime'
 WHEN len(top) > 0 AND unique_count <= 4
  AND len(list_filter(top, lambda x: lower(trim(x)) NOT IN ({quoted(BOOLEAN_WORDS)}))) = 0 THEN 'boolean'
 WHEN dtype = 'object' AND unique_count BETWEEN 2 AND 50 AND unique_pct < 10 THEN 'categorical'
 WHEN regexp_matches(lower(column_name), '({_any(ID_SUFFIXES)})$') AND unique_pct > 70 THEN 'identifier'
 WHEN regexp_matches(lower(column_name), '{_any(CURRENCY_NAMES)}') THEN 'currency'
 WHEN dtype = 'int' THEN 'integer'
 WHEN dtype = 'float' THEN 'float'
 WHEN dtype = 'object' AND unique_pct > 60 THEN 'free_text'
 ELSE 'unknown' END"""

HEALTH = """CASE
 WHEN null_pct > 20 OR coalesce(future_date_pct, 0) > 5 OR coalesce(invalid_email_count, 0) > 0 THEN 'CRITICAL'
 WHEN null_pct > 5 OR coalesce(negative_count, 0) > 0 THEN 'WARNING'
 ELSE 'HEALTHY' END"""

ABS_SAFE = (f"(NOT regexp_matches(lower(column_name), '{_any(SIGNED_NAMES)}') "
            f"AND regexp_matches(lower(column_name), '{_any(UNSIGNED_NAMES)}'))")
