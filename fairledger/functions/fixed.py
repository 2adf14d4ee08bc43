"""Word lists, patterns and thresholds that results depend on."""

# Whitespace as JavaScript's trim() and \s see it.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same blanks as the inside of a Java character class.
WS_CLASS = (
    r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

TYPES = ["integer", "decimal", "boolean", "date", "string"]
BOOLEAN_WORDS = ["true", "false", "yes", "no", "y", "n"]
INTEGER = r"\A-?[0-9]+\z"
DECIMAL = r"\A-?[0-9]+\.[0-9]+\z"
DATE = (
    r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2})?)?\z"
    r"|\A[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"
)
STRICT_INTEGER = r"\A-?[1-9][0-9]*\z|\A0\z"
STRICT_DECIMAL = r"\A-?[0-9]+\.[0-9]{2}\z"
STRICT_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
STRICT_BOOLEAN = ["true", "false"]
NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
LARGEST_NUMBER = 1.7976931348623157e308

SENTINELS = ["n/a", "na", "null", "none", "unknown", "tbd", "-", "--", "???", "#n/a"]
NULL_COMPLETENESS = 0.8
IQR_FACTOR = 1.5
MIN_NUMBERS = 4
MIN_SHAPES = 4
SHAPE_SHARE = 0.6

SEMANTIC_TYPES = [
    "email", "url", "phone_number", "currency_code", "country_code", "postal_code", "percentage",
    "currency_amount", "identifier", "tax_id", "organization_name", "person_name", "address_line",
]
VALUE_SHARE = 0.7
EMAIL = rf"\A[^@{WS_CLASS}]+@[^@{WS_CLASS}]+\.[^@{WS_CLASS}]+\z"
URL = rf"\A(?i:https?)://[^{WS_CLASS}]+\z"
PHONE = rf"\A[+()0-9{WS_CLASS}.-]{{7,20}}\z"
CURRENCY_CODES = [
    "USD", "EUR", "GBP", "JPY", "CNY", "INR", "AUD", "CAD", "CHF", "SGD",
    "MXN", "BRL", "ZAR", "SEK", "NOK", "DKK", "AED", "SAR", "KRW", "HKD",
]
COUNTRY_CODES = [
    "US", "GB", "DE", "FR", "IT", "ES", "NL", "BE", "CH", "AT", "CA", "MX", "BR",
    "IN", "CN", "JP", "KR", "AU", "SG", "ZA", "SE", "NO", "DK", "AE", "SA",
]
COUNTRY_HINT = r"country"
PHONE_HINT = r"phone|tel(ephone)?|fax|mobile"
PERCENT_HINT = r"percent|_rate\z|\Arate\z"
# (semantic type, pattern over the lower-cased column name, allowed inferred types or None)
NAME_RULES = [
    ("postal_code", r"zip|postal", ["string", "integer"]),
    ("currency_amount",
     r"amount|price|cost|total|balance|credit_limit|revenue|spend|value", ["integer", "decimal"]),
    ("tax_id", r"tax_?id|vat_?(number|id)?|ein(?![A-Za-z0-9_])", None),
    ("identifier", r"(\A|_)(id|code|number|no)(\z|_)", None),
    ("organization_name",
     r"company|corp|organization|org_name|supplier_name|vendor_name|business_name", ["string"]),
    ("person_name",
     r"contact_name|person_name|first_name|last_name|full_name|employee_name", ["string"]),
    ("address_line", r"address|street|addr_line", ["string"]),
]
QUEUE_SHAPES = 12

LEGAL_SUFFIXES = [
    "INCORPORATED", "CORPORATION", "COMPANY", "LIMITED", "GMBH", "LLC", "LLP", "INC", "CORP",
    "CO", "LTD", "LP", "PLC", "AG", "SA", "SRL", "BV",
]
NAME_SIMILARITY = 0.5
# own choice: pairs of similar names are listed one by one from this address similarity on
ADDRESS_SIMILARITY = 0.5
AMBIGUOUS = (0.5, 0.9)
WEIGHT_NAME, WEIGHT_ADDRESS = 0.65, 0.35
NAME_ALONE, ADDRESS_ALONE = 0.85, 0.7

DECISIONS = ["needs_review", "merge", "keep_separate", "reject"]
RECOMMENDATIONS = ["merge", "keep_separate", "uncertain"]
ANOMALY_TYPES = ["null", "malformed_value", "outlier", "suspicious_pattern"]
BP_TYPES = ["organization", "person", "unknown"]
SUPPLIER_STATUSES = ["active", "inactive", "obsolete"]
ROLE_PERMISSIONS = {
    "VIEWER": ["view"],
    "STEWARD": ["view", "modify"],
    "APPROVER": ["view", "modify", "approve"],
    "EXPORTER": ["view", "export"],
    "ADMIN": ["view", "modify", "approve", "export", "admin"],
}

DELIMITERS = [",", ";", "\t", "|"]
DIALECT_LINES = 20
HEADER_ROWS = 20
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_ROWS = 200_000
