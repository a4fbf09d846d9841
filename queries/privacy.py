"""Personal data: detection, risk and masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataward.constants import (
    PATTERN_BOUND_TYPES,
    PII_EXCLUSIONS,
    PII_KEYWORDS,
    PII_PATTERNS,
    RISK_WEIGHTS,
    TOKENIZE_TYPES,
)
from dataward.functions.masks import mask
from dataward.functions.names import pii_type_of_name
from dataward.operators import catalog, masking, pii, risk
from queries.fixtures import VIEWS, oracle, table
from queries.registry import query
from queries.sqlparts import COLUMNS, quoted

# ---- keywords -------------------------------------------------------------------

KEYWORDS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{t}', '{w}')" for i, (t, words) in enumerate(PII_KEYWORDS.items())
    for w in words) + ") k(place, pii_type, word)"


def keyword_type(name: str) -> str:
    """SQL for the type a column name suggests, from the keyword list."""
    return (f"CASE WHEN lower(trim({name})) NOT IN ({quoted(PII_EXCLUSIONS)}) THEN "
            f"(SELECT min_by(pii_type, place) FROM keywords WHERE lower({name}) = word "
            f"OR ends_with(lower({name}), '_' || word) OR starts_with(lower({name}), word || '_') "
            f"OR (length(word) >= 4 AND contains(lower({name}), word))) END")


@query("pii_keywords", oracle(f"""
SELECT table_name, ordinal, c.column_name, t.pii_type FROM column_names c JOIN (
 SELECT column_name, {keyword_type('column_name')} AS pii_type
 FROM (SELECT DISTINCT column_name FROM column_names)) t USING (column_name)""",
    "column_names", ctes={"keywords": KEYWORDS}))
def pii_keywords(spark, sf):
    return table(spark, sf, "column_names").withColumn(
        "pii_type", pii_type_of_name(F.col("column_name")))


# ---- samples, scores, detections --------------------------------------------------

MORE_COLUMNS = {
    "supplier": [("s_suppkey", "int"), ("s_name", "object"), ("s_nationkey", "int"),
                 ("s_acctbal", "float")],
    "nation": [("n_nationkey", "int"), ("n_name", "object"), ("n_regionkey", "int")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "object"),
                      ("text", "object")],
    "pages": [("page_id", "int"), ("url", "object"), ("html", "object")],
}
SCANNED = ["customer_pii", "dirty_patients", "customer", "supplier", "nation", "part",
           "documents", "conversations", "pages", "events"]


def columns_sql() -> str:
    rows = [(t, c, i) for t in SCANNED
            for i, (c, _) in enumerate((COLUMNS | MORE_COLUMNS)[t])]
    return "SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', '{c}', {i})" for t, c, i in rows) + ") c(table_name, column_name, ordinal)"


def samples_sql() -> str:
    parts = [f"SELECT '{t}' AS table_name, '{c}' AS column_name, v AS value, "
             f"row_number() OVER (ORDER BY v) AS rank FROM (SELECT DISTINCT "
             f"cast({c} AS varchar) AS v FROM {t} WHERE {c} IS NOT NULL "
             f"AND cast({c} AS varchar) <> '') QUALIFY rank <= 20"
             for t in SCANNED for c, _ in (COLUMNS | MORE_COLUMNS)[t]]
    return "\nUNION ALL\n".join(parts)


def hit(pii_type: str, value: str = "trim(value)") -> str:
    return "CASE " + pii_type + " " + " ".join(
        f"WHEN '{t}' THEN regexp_matches({value}, '{p}')" for t, p in PII_PATTERNS.items()
    ) + " ELSE false END"


SCORES = f"""
SELECT *, CASE WHEN keyword_type IS NULL AND samples > 0 THEN CASE
  WHEN email_shape > 0.5 THEN 'EMAIL' WHEN phone_score > 0.5 THEN 'PHONE'
  WHEN regexp_matches(lower(column_name), 'name|naam') AND alphabetic THEN 'NAME' END END AS shape_type,
 CASE WHEN samples > 0 AND email_shape > 0.5 THEN email_score
  WHEN samples > 0 AND phone_score > 0.5 THEN phone_score ELSE 0.0 END AS shape_score
FROM (SELECT c.table_name, c.column_name, c.ordinal, c.keyword_type, count(value) AS samples,
 avg(CASE WHEN {hit('keyword_type')} THEN 1.0 ELSE 0.0 END) AS keyword_score,
 avg(CASE WHEN contains(value, '@') AND contains(value, '.') THEN 1.0 ELSE 0.0 END) AS email_shape,
 avg(CASE WHEN regexp_matches(trim(value), '{PII_PATTERNS['PHONE']}') THEN 1.0 ELSE 0.0 END) AS phone_score,
 avg(CASE WHEN regexp_matches(trim(value), '{PII_PATTERNS['EMAIL']}') THEN 1.0 ELSE 0.0 END) AS email_score,
 coalesce(bool_and(regexp_matches(replace(value, ' ', ''), '^[A-Za-z]+$')) FILTER (rank <= 5), false) AS alphabetic,
 array_to_string(list(value ORDER BY rank) FILTER (rank <= 5), '|') AS sample_values
FROM (SELECT *, {keyword_type('column_name')} AS keyword_type FROM scanned_columns) c
LEFT JOIN samples s USING (table_name, column_name) GROUP BY ALL)"""
DETECTED = f"""
SELECT table_name, column_name, ordinal, coalesce(keyword_type, shape_type) AS pii_type, round(CASE
  WHEN keyword_type IS NOT NULL AND samples > 0 AND keyword_score > 0.3 THEN least(0.95, 0.7 + keyword_score * 0.3)
  WHEN samples > 0 AND keyword_score = 0 AND keyword_type IN ({quoted(PATTERN_BOUND_TYPES)}) THEN 0.4
  WHEN keyword_type IS NOT NULL THEN 0.7
  WHEN shape_score > 0.3 THEN least(0.9, 0.6 + shape_score * 0.3) ELSE 0.6 END, 2)::double AS confidence,
 CASE WHEN keyword_type IS NOT NULL AND samples > 0 AND keyword_score > 0.3 THEN 'keyword+regex'
  WHEN samples > 0 AND keyword_score = 0 AND keyword_type IN ({quoted(PATTERN_BOUND_TYPES)}) THEN 'keyword_only'
  WHEN keyword_type IS NOT NULL THEN 'keyword'
  WHEN shape_score > 0.3 THEN 'semantic+regex' ELSE 'semantic' END AS detection_method,
 sample_values
FROM scores WHERE coalesce(keyword_type, shape_type) IS NOT NULL"""
PII_CTES = {"keywords": KEYWORDS, "scanned_columns": columns_sql(), "samples": samples_sql(),
            "scores": SCORES, "detected": DETECTED}
PII_VIEWS = [t for t in SCANNED if t in VIEWS]


def scanned(spark, sf):
    return {t: table(spark, sf, t) for t in SCANNED}


@query("pii_samples", oracle(
    "SELECT table_name, column_name, rank, value FROM samples", *PII_VIEWS,
    ctes={"samples": samples_sql()}))
def pii_samples(spark, sf):
    """The 20 smallest distinct values of every column of ten tables."""
    return pii.columns_and_samples(scanned(spark, sf))[1].withColumn("rank", F.col("rank").cast("bigint"))


@query("pii_regex_score", oracle(
    "SELECT table_name, column_name, samples, keyword_type, round(keyword_score, 4) AS "
    "keyword_score, shape_type, round(shape_score, 4)::double AS shape_score FROM scores",
    *PII_VIEWS, ctes={k: v for k, v in PII_CTES.items() if k != "detected"}))
def pii_regex_score(spark, sf):
    return pii.score_columns(*pii.columns_and_samples(scanned(spark, sf))).select(
        "table_name", "column_name", "samples", "keyword_type",
        F.round("keyword_score", 4).alias("keyword_score"), "shape_type",
        F.round("shape_score", 4).alias("shape_score"))


@query("pii_detect", oracle(
    "SELECT table_name, column_name, pii_type, confidence, detection_method, sample_values "
    "FROM detected", *PII_VIEWS, ctes=PII_CTES))
def pii_detect(spark, sf):
    return pii.detect_pii(scanned(spark, sf)).drop("ordinal").withColumn(
        "sample_values", F.array_join("sample_values", "|"))


# ---- risk -------------------------------------------------------------------------

def weight(pii_type: str, default: str) -> str:
    return f"CASE {pii_type} " + " ".join(
        f"WHEN '{t}' THEN {w}" for t, w in RISK_WEIGHTS.items()) + f" ELSE {default} END"


def level(score: str) -> str:
    return (f"CASE WHEN {score} >= 0.8 THEN 'CRITICAL' WHEN {score} >= 0.6 THEN 'HIGH' "
            f"WHEN {score} >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END")


def percent(value: str) -> str:
    return f"cast(cast(round({value} * 100) AS int) AS varchar) || '%'"


LATEST_TAGS = """SELECT run_id, table_name, column_name, arg_max(pii_type, seq) AS pii_type,
 arg_max(confidence, seq) AS confidence FROM tag_log GROUP BY ALL"""
RUN_SCORES = f"""
SELECT *, CASE WHEN edges > 5 THEN least(1.0, round(base + 0.1, 10)) ELSE base END AS score FROM (
 SELECT run_id, count(*) AS pii_count, count(DISTINCT table_name) AS pii_tables,
  array_to_string(list_sort(list(DISTINCT pii_type)), ', ') AS pii_types,
  least(1.0, round(max({weight('pii_type', '0.5')}::double * confidence) * 0.7 + count(*) / 10 * 0.3, 10)) AS base,
  coalesce(any_value(e.edges), 0) AS edges
 FROM tags LEFT JOIN (SELECT run_id, count(*) AS edges FROM edge_log GROUP BY 1) e USING (run_id)
 GROUP BY run_id)"""
FLEET_CTES = {"tags": LATEST_TAGS, "run_scores": RUN_SCORES}


def fleet(spark, sf):
    """Current detections and edges of a hundred runs, from the logs."""
    tags = catalog.latest(table(spark, sf, "tag_log"),
                          ["run_id", "table_name", "column_name"], "seq")
    return tags, table(spark, sf, "edge_log")


@query("risk_report_fleet", oracle(f"""
SELECT run_id, {level('score')} AS risk_level, round(score, 2) AS risk_score, pii_count,
 'Detected ' || pii_count || ' PII column(s) (' || pii_types || ') across ' || pii_tables
 || ' table(s). Overall risk: ' || {level('score')} || ' (' || {percent('score')} || ').' AS summary,
 coalesce(n, 0) AS tables_analyzed
FROM run_scores LEFT JOIN (SELECT run_id, count(DISTINCT t) AS n FROM (
 SELECT run_id, src_table AS t FROM edge_log UNION ALL SELECT run_id, tgt_table FROM edge_log)
 GROUP BY 1) USING (run_id)""", "tag_log", "edge_log", ctes=FLEET_CTES))
def risk_report_fleet(spark, sf):
    tags, edges = fleet(spark, sf)
    return risk.risk_report(tags, edges, ["run_id"])


@query("recommendations_fleet", oracle(f"""
SELECT run_id, table_name, column_name, pii_type, 'mask' AS action,
 CASE WHEN {weight('pii_type', '0.5')} >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
 'Apply ' || pii_type || '-specific masking to ''' || column_name || ''' (confidence: ' || {percent('confidence')} || ')' AS detail FROM tags
UNION ALL SELECT run_id, table_name, column_name, pii_type, 'restrict_access', 'CRITICAL',
 'Restrict access to ''' || column_name || ''' — contains ' || pii_type || ' data' FROM tags WHERE {weight('pii_type', '0')} >= 0.8
UNION ALL SELECT run_id, table_name, column_name, pii_type, 'tokenize', 'HIGH',
 'Consider tokenization for ''' || column_name || ''' (' || pii_type || ') for downstream analytics' FROM tags WHERE pii_type IN ({quoted(TOKENIZE_TYPES)})
UNION ALL SELECT run_id, '*', '*', 'GENERAL', 'audit_logging', 'HIGH',
 'Enable audit logging for all access to tables containing PII' FROM run_scores WHERE {level('score')} IN ('HIGH', 'CRITICAL')""",
    "tag_log", "edge_log", ctes=FLEET_CTES))
def recommendations_fleet(spark, sf):
    tags, edges = fleet(spark, sf)
    counts = edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges"))
    return risk.recommendations(tags, risk.risk_scores(tags, counts, ["run_id"]), ["run_id"])


RISK = f"""SELECT {level('score')} AS risk_level, round(score, 2) AS risk_score, pii_count,
 'Detected ' || pii_count || ' PII column(s) (' || pii_types || ') across ' || pii_tables
 || ' table(s). Overall risk: ' || {level('score')} || ' (' || {percent('score')} || ').' AS summary,
 tables_analyzed
FROM (SELECT *, least(1.0, round(base + CASE WHEN edges > 5 THEN 0.1 ELSE 0 END, 10)) AS score FROM (
 SELECT count(*) AS pii_count, count(DISTINCT table_name) AS pii_tables,
  array_to_string(list_sort(list(DISTINCT pii_type)), ', ') AS pii_types,
  least(1.0, round(max({weight('pii_type', '0.5')}::double * confidence) * 0.7 + count(*) / 10 * 0.3, 10)) AS base,
  (SELECT count(*) FROM edge_log) AS edges,
  (SELECT count(DISTINCT t) FROM (SELECT src_table AS t FROM edge_log
   UNION ALL SELECT tgt_table FROM edge_log)) AS tables_analyzed FROM detected))"""


@query("risk_report", oracle(RISK, *PII_VIEWS, "edge_log", ctes=PII_CTES))
def risk_report(spark, sf):
    """One run over ten scanned tables and the whole edge log."""
    return risk.risk_report(pii.detect_pii(scanned(spark, sf)), table(spark, sf, "edge_log"))


@query("risk_report_empty", oracle("""
SELECT 'LOW' AS risk_level, 0.0::double AS risk_score, 0::bigint AS pii_count,
 'No PII detected. Data governance risk is minimal.' AS summary,
 (SELECT count(DISTINCT t) FROM (SELECT src_table AS t FROM edge_log
  UNION ALL SELECT tgt_table FROM edge_log)) AS tables_analyzed""", "edge_log"))
def risk_report_empty(spark, sf):
    """Lineage without any detection."""
    none = table(spark, sf, "tag_log").where("pii_type = 'NONE'")
    return risk.risk_report(none, table(spark, sf, "edge_log"))


# ---- masks ------------------------------------------------------------------------

def _filled(value: str, masked: str) -> str:
    return f"CASE WHEN {value} IS NULL OR trim({value}) = '' THEN {value} ELSE {masked} END"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '\\D', '', 'g')"


def _last_four(v: str, short: str, head: str) -> str:
    d = _digits(v)
    return (f"CASE WHEN length({d}) < 4 THEN '{short}' ELSE "
            f"{head.format(n=f'length({d}) - 4')} || right({d}, 4) END")


def _ends(v: str) -> str:
    return (f"CASE WHEN length(trim({v})) <= 2 THEN repeat('*', length(trim({v}))) ELSE "
            f"left(trim({v}), 1) || repeat('*', length(trim({v})) - 2) || right(trim({v}), 1) END")


MASK_SQL = {
    "EMAIL": lambda v: (f"CASE WHEN strpos({v}, '@') = 0 THEN {v} WHEN strpos({v}, '@') <= 2 "
                        f"THEN '*' || substr({v}, strpos({v}, '@')) ELSE left({v}, 1) || '***' "
                        f"|| substr({v}, strpos({v}, '@')) END"),
    "PHONE": lambda v: _last_four(v, "****", "repeat('*', {n})"),
    "NAME": lambda v: (f"array_to_string(list_transform(regexp_split_to_array(trim({v}), '\\s+'), "
                       "lambda w: CASE WHEN length(w) <= 1 THEN '*' ELSE left(w, 1) || "
                       "repeat('*', length(w) - 1) END), ' ')"),
    "ADDRESS": lambda v: "'REDACTED'",
    "AADHAAR": lambda v: _last_four(v, "XXXX XXXX XXXX", "'XXXX XXXX '"),
    "PAN": lambda v: (f"CASE WHEN length(trim({v})) = 10 THEN 'XXXXX' || "
                      f"substr(upper(trim({v})), 6, 4) || 'X' ELSE 'XXXXXXXXXX' END"),
    "PASSPORT": _ends,
    "SSN": lambda v: _last_four(v, "***-**-****", "'***-**-'"),
    "CREDIT_CARD": lambda v: _last_four(v, "****************", "repeat('*', {n})"),
    "DOB": lambda v: (f"CASE WHEN regexp_matches(trim({v}), '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') "
                      f"THEN left(trim({v}), 4) || '-**-**' ELSE '****-**-**' END"),
    "IP": lambda v: (f"CASE WHEN len(string_split(trim({v}), '.')) = 4 THEN "
                     f"split_part(trim({v}), '.', 1) || '.' || split_part(trim({v}), '.', 2) "
                     "|| '.*.*' ELSE '*.*.*.*' END"),
    "OTHER": _ends,
}
MASKED_COLUMNS = {
    "EMAIL": ["email", "handle", "full_name"], "PHONE": ["phone_number", "dob", "product_name"],
    "NAME": ["full_name", "handle"], "ADDRESS": ["home_address", "handle"],
    "AADHAAR": ["aadhaar_number", "full_name"], "PAN": ["pan_number", "passport_no"],
    "PASSPORT": ["passport_no", "full_name"], "SSN": ["ssn", "full_name"],
    "CREDIT_CARD": ["card_number", "handle"], "DOB": ["dob", "ssn"],
    "IP": ["client_ip", "email"], "OTHER": ["full_name", "handle"],
}


def mask_sql(pii_type: str, column: str) -> str:
    return _filled(column, MASK_SQL[pii_type](column))


def _register(pii_type, columns):
    @query(f"mask_{pii_type.lower()}", oracle(
        "SELECT row_key, " + ", ".join(
            f"{mask_sql(pii_type, c)} AS {c}" for c in columns) + " FROM customer_pii",
        "customer_pii"))
    def run(spark, sf):
        return table(spark, sf, "customer_pii").select(
            "row_key", *[mask(F.col(c), pii_type).alias(c) for c in columns])


for _type, _columns in MASKED_COLUMNS.items():
    _register(_type, _columns)

DETECTED_TYPES = {
    "email": "EMAIL", "phone_number": "PHONE", "full_name": "NAME", "home_address": "ADDRESS",
    "aadhaar_number": "AADHAAR", "pan_number": "PAN", "passport_no": "PASSPORT", "ssn": "SSN",
    "card_number": "CREDIT_CARD", "dob": "DOB", "client_ip": "IP", "ip_address": "ADDRESS",
    "product_name": "NAME", "handle": "EMAIL", "signup_day": "PHONE",
}


@query("mask_table", oracle(
    "SELECT row_key, " + ", ".join(
        f"{mask_sql(t, c)} AS {c}" for c, t in DETECTED_TYPES.items())
    + " FROM customer_pii", "customer_pii"))
def mask_table(spark, sf):
    """Detect, then mask every detected column of the table."""
    tables = {"customer_pii": table(spark, sf, "customer_pii")}
    return masking.mask_tables(tables, pii.detect_pii(tables))["customer_pii"]


@query("masking_details", oracle(" UNION ALL ".join(
    f"SELECT 'customer_pii' AS table_name, '{c}' AS column_name, '{t}' AS pii_type, "
    f"row_number() OVER (ORDER BY row_key) AS rank, {c} AS before, {mask_sql(t, c)} AS after "
    f"FROM customer_pii WHERE {c} IS NOT NULL QUALIFY rank <= 3"
    for c, t in DETECTED_TYPES.items()), "customer_pii"))
def masking_details(spark, sf):
    return masking.masking_details(
        table(spark, sf, "customer_pii"), DETECTED_TYPES, "row_key", "customer_pii").withColumn(
        "rank", F.col("rank").cast("bigint"))


@query("masking_summary", oracle("""
SELECT d.table_name, count(*) AS columns_masked, array_to_string(list(column_name ORDER BY column_name), ',') AS columns,
 any_value(CASE d.table_name WHEN 'customer' THEN (SELECT count(*) FROM customer)
  WHEN 'part' THEN (SELECT count(*) FROM part) ELSE (SELECT count(*) FROM customer_pii) END) AS rows_affected
FROM detected d WHERE table_name IN ('customer_pii', 'customer', 'part') GROUP BY d.table_name""",
    *PII_VIEWS, ctes=PII_CTES))
def masking_summary(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("customer_pii", "customer", "part")}
    return masking.masking_summary(tables, pii.detect_pii(tables))
