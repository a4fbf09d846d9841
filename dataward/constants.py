"""Fixed values. Results depend on these exact words, numbers and orders."""

from __future__ import annotations

# ---- ingest ---------------------------------------------------------------
# Tokens the CSV reader treats as null.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Candidate delimiters, the first is the default.
DELIMITERS = [",", ";", "\t", "|"]

# ---- limits ---------------------------------------------------------------
MAX_CYCLES = 5            # heal -> validate rounds before an alert
GUARD_SHARE = 0.5         # a quarantine hitting more than this share does nothing
FAILING_KEYS = 50         # keys listed per failing rule
TOP_VALUES = 10
CATEGORY_VALUES = 50      # a categorical column has at most so many values
PII_SAMPLES = 20
MIN_DATE = "1900-01-01"

# ---- semantic types -------------------------------------------------------
# Name fragments per semantic type, in rule order.
EMAIL_NAMES = ["email", "e_mail", "e-mail", "mail"]
URL_NAMES = ["url", "uri", "link", "href", "website", "site"]
PHONE_NAMES = ["phone", "mobile", "tel", "fax", "contact_no", "phone_number", "cell"]
DATETIME_NAMES = [
    "date", "time", "timestamp", "created_at", "updated_at", "modified_at",
    "created_on", "dob", "birthdate", "hired",
]
BOOLEAN_WORDS = [
    "true", "false", "yes", "no", "1", "0", "t", "f", "y", "n",
    "active", "inactive", "enabled", "disabled",
]
ID_SUFFIXES = [
    "_id", "_key", "_code", "_num", "_no", "_ref", "_uuid", "_guid", "id", "key", "code",
]
CURRENCY_NAMES = [
    "price", "amount", "cost", "fee", "charge", "revenue", "salary", "wage", "total",
    "sum", "balance", "value", "spend", "budget", "payment", "earnings", "profit",
]
NUMERIC_TYPES = ["currency", "integer", "float"]
PRIORITY_TYPES = ["email", "currency", "datetime", "categorical", "identifier"]
# Name fragments that make a quarantine treat a column as a date.
DATE_COLUMN_NAMES = ["date", "time", "timestamp", "dob", "born"]

# ---- rules ----------------------------------------------------------------
NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
BETWEEN = "expect_column_values_to_be_between"
IN_SET = "expect_column_values_to_be_in_set"
REGEX = "expect_column_values_to_match_regex"
OF_TYPE = "expect_column_values_to_be_of_type"
DATEUTIL = "expect_column_values_to_be_dateutil_parseable"
RULE_TYPES = [NOT_NULL, UNIQUE, BETWEEN, IN_SET, REGEX, OF_TYPE, DATEUTIL]

# Accepted other names of rule types.
RULE_SYNONYMS = {
    "within_range": BETWEEN,
    "unique": UNIQUE,
    "not_null": NOT_NULL,
    "no_nulls": NOT_NULL,
    "before_or_equal_to": BETWEEN,
    "in_set": IN_SET,
    "match_regex": REGEX,
    "is_unique": UNIQUE,
    "expect_column_values_to_be_valid_email": REGEX,
}
EMAIL_REGEX = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

# ---- healing --------------------------------------------------------------
# Names whose negative values are legitimate / are errors.
SIGNED_NAMES = [
    "balance", "delta", "diff", "change", "variance", "temperature", "temp", "offset",
    "gain", "loss", "latitude", "longitude", "lat", "lon", "lng", "profit_loss", "return",
]
UNSIGNED_NAMES = [
    "price", "amount", "cost", "fee", "charge", "revenue", "salary", "wage", "total",
    "sum", "payment", "earnings", "spend", "budget", "quantity", "qty", "count",
    "distance", "weight", "height", "age",
]
ACTION_TYPES = ["quarantine", "fix_value", "deduplicate"]
FIX_OPERATIONS = [
    "abs", "replace_invalid_categorical", "replace_invalid_status", "replace_empty_string",
]
CATEGORICAL_FIXES = ["replace_invalid_categorical", "replace_invalid_status"]
# Confidence of each repair, by action type and operation/condition.
REPAIR_CONFIDENCE = [
    ("quarantine", "is_null", 0.99),
    ("quarantine", "is_duplicate", 0.97),
    ("quarantine", "is_future_date", 0.92),
    ("quarantine", "out_of_bounds", 0.75),
    ("fix_value", "abs", 0.82),
    ("fix_value", "replace_invalid_categorical", 0.70),
    ("fix_value", "replace_invalid_status", 0.70),
    ("fix_value", "replace_empty_string", 0.65),
    ("deduplicate", None, 0.95),
]
DEFAULT_CONFIDENCE = 0.50

# ---- personal data --------------------------------------------------------
# Column-name keywords per type, in type order.
PII_KEYWORDS = {
    "EMAIL": ["email", "e_mail", "e-mail", "mail_address", "email_address"],
    "PHONE": ["phone", "mobile", "cell", "telephone", "contact_number", "phone_number"],
    "NAME": ["name", "first_name", "last_name", "full_name", "customer_name",
             "patient_name", "user_name", "person_name"],
    "ADDRESS": ["address", "street", "city", "zip", "zipcode", "postal", "addr",
                "residence", "location", "home_address"],
    "AADHAAR": ["aadhaar", "aadhar", "aadhaar_number", "aadhar_number", "uid"],
    "PAN": ["pan", "pan_number", "pan_card"],
    "PASSPORT": ["passport", "passport_number", "passport_no"],
    "DOB": ["dob", "date_of_birth", "birth_date", "birthdate"],
    "SSN": ["ssn", "social_security", "social_security_number"],
    "IP": ["ip_address", "ip_addr", "client_ip", "source_ip"],
    "CREDIT_CARD": ["credit_card", "card_number", "cc_number", "card_num"],
}
PII_EXCLUSIONS = [
    "product_name", "category_name", "table_name", "column_name", "file_name",
    "suite_name", "index_name", "game_name", "shipping_address",
]
# Value patterns per type.
PII_PATTERNS = {
    "EMAIL": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "PHONE": r"^[\+]?[\d\s\-\(\)]{7,15}$",
    "AADHAAR": r"^\d{4}\s?\d{4}\s?\d{4}$",
    "PAN": r"^[A-Z]{5}\d{4}[A-Z]$",
    "PASSPORT": r"^[A-Z]\d{7}$",
    "SSN": r"^\d{3}-?\d{2}-?\d{4}$",
    "CREDIT_CARD": r"^\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}$",
    "IP": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}
# Types whose keyword alone is weak when no value matches the pattern.
PATTERN_BOUND_TYPES = ["AADHAAR", "PAN", "PASSPORT", "SSN", "CREDIT_CARD"]
TOKENIZE_TYPES = ["AADHAAR", "PAN", "SSN", "PASSPORT", "CREDIT_CARD"]
# Risk weight per type.
RISK_WEIGHTS = {
    "EMAIL": 0.6, "PHONE": 0.6, "NAME": 0.5, "ADDRESS": 0.7, "AADHAAR": 0.95,
    "PAN": 0.9, "PASSPORT": 0.9, "DOB": 0.5, "SSN": 0.95, "IP": 0.4, "CREDIT_CARD": 0.95,
}
DEFAULT_WEIGHT = 0.5

# Own text: the reason of rows whose date has two readings.
AMBIGUOUS_DATE = "Ambiguous date: day and month cannot be told apart"
