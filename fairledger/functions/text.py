"""Column expressions over text: trimming, classifying, match keys, trigram similarity.

Everything here is `Column -> Column` made of built-in functions, so it stays inside Spark's
generated code. Patterns use \\A..\\z and ASCII classes because Java's `$` also matches before a
final newline and its `\\b` is Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairledger.functions import fixed as K


def js_trim(c: Column) -> Column:
    """Trim every Unicode blank (Spark's own trim strips spaces only).

    Most text starts and ends with printable ASCII and is passed on without a search.
    """
    def printable(end: Column) -> Column:
        return end.between("!", "~")

    return F.when(
        printable(F.substring(c, 1, 1)) & printable(F.substring(c, -1, 1)), c
    ).otherwise(F.btrim(c, F.lit(K.WHITESPACE)))


def is_blank(c: Column) -> Column:
    return js_trim(F.coalesce(c, F.lit(""))) == ""


def classify_trimmed(v: Column) -> Column:
    """As `classify_value`; a look at a few characters decides which pattern is worth trying.

    A decimal has a point, a date a dash after its year or slashes, and no other form has these.
    """
    def form(pattern: str, name: str) -> Column:
        return F.when(v.rlike(pattern), name).otherwise("string")

    numeric = (
        F.when(v.contains("."), form(K.DECIMAL, "decimal"))
        .when((F.substring(v, 5, 1) == "-") | v.contains("/"), form(K.DATE, "date"))
        .otherwise(form(K.INTEGER, "integer"))
    )
    word = (F.length(v) <= 5) & F.lower(v).isin(K.BOOLEAN_WORDS)
    return (
        F.when(F.substring(v, 1, 1).between("-", "9"), numeric)
        .when(word, "boolean")
        .otherwise("string")
    )


def classify_value(c: Column) -> Column:
    """integer, decimal, boolean, date or string, by pattern only (no calendar check)."""
    return classify_trimmed(js_trim(c))


def strict_form(v: Column, type_: str) -> Column:
    """Has a trimmed value the strict form of a type other than string?"""
    return {
        "integer": v.rlike(K.STRICT_INTEGER),
        "decimal": v.rlike(K.STRICT_DECIMAL),
        "date": v.rlike(K.STRICT_DATE),
        "boolean": F.lower(v).isin(K.STRICT_BOOLEAN),
    }[type_]


def conforms_strictly(raw: Column, type_: Column) -> Column:
    """Strict form of the type (ISO date, two decimals, ...); for text, no outer blanks."""
    v = js_trim(raw)
    chain = F
    for t in K.TYPES[:-1]:
        chain = chain.when(type_ == t, strict_form(v, t))
    return chain.otherwise(raw == v)


def shape(c: Column) -> Column:
    """Digit runs become D, then letter runs become A.

    The D's are letters by then, so any run of digits and letters ends as one A: `AB12` and `2024`
    are both `A`, a date is `A-A-A`.
    """
    return F.regexp_replace(c, "[0-9A-Za-z]+", "A")


def is_sentinel(v: Column) -> Column:
    """Placeholder such as `N/A` typed in place of a missing value; `v` is trimmed."""
    return F.lower(v).isin(K.SENTINELS)


def to_number(v: Column) -> Column:
    """Finite number from trimmed text, with or without exponent; else null.

    The pattern gates the cast because Spark also reads `1d`, `NaN` and `Infinity`. It gates the
    text that is cast, not the result: Spark works out a repeated expression ahead of the conditions
    around it, and a cast of other text costs an exception.
    """
    return finite(F.when(F.substring(v, 1, 1).between("+", "9") & v.rlike(K.NUMBER), v))


def finite(text: Column) -> Column:
    """Number of a text known to be one, or null; null also beyond the largest double."""
    number = text.try_cast("double")
    return F.when(F.abs(number) <= K.LARGEST_NUMBER, number)


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(js_trim(c), f"[{K.WS_CLASS}]+", " ")


def normalize_display_text(c: Column) -> Column:
    """Trimmed, single-spaced text with its own casing; null becomes empty."""
    return collapse_blanks(F.coalesce(c, F.lit("")))


normalize_address_line = normalize_display_text


def name_match_key(c: Column) -> Column:
    """Comparison key of a name: upper case, no punctuation, no legal-form words."""
    letters = F.regexp_replace(
        F.upper(F.coalesce(c, F.lit(""))), rf"[^\p{{L}}\p{{N}}{K.WS_CLASS}]", " "
    )
    words = "|".join(K.LEGAL_SUFFIXES)
    bare = F.regexp_replace(letters, rf"(?<![A-Za-z0-9_])({words})(?![A-Za-z0-9_])", " ")
    return collapse_blanks(bare)


def normalize_country_code(c: Column) -> Column:
    return F.upper(js_trim(F.coalesce(c, F.lit(""))))


def normalize_postal_code(c: Column) -> Column:
    return F.regexp_replace(normalize_country_code(c), f"[{K.WS_CLASS}]+", "")


def address_match_key(line1: Column, city: Column, postal: Column, country: Column) -> Column:
    """Comparison key of an address; line 2 and region are left out on purpose."""
    parts = F.array(
        name_match_key(line1),
        normalize_country_code(city),
        normalize_postal_code(postal),
        normalize_country_code(country),
    )
    return collapse_blanks(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def identifier_match_key(c: Column) -> Column:
    """Upper-cased identifier without blanks, dashes, dots and slashes."""
    return F.regexp_replace(
        F.upper(js_trim(F.coalesce(c, F.lit("")))), rf"[{K.WS_CLASS}\-./]+", ""
    )


def address_text(line1: Column, city: Column, postal: Column, country: Column) -> Column:
    """One line of address text; null when there is nothing in it."""
    return F.nullif(F.concat_ws(" ", line1, city, postal, country), F.lit(""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after.

    One regex pass with a look-ahead yields all overlapping windows of the padded text. A window is
    a trigram when its middle is a word character, or when it is two blanks and a word character.
    Windows end with their word, so a word that occurs again is left out before they are made.
    """
    words = F.array_join(F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+")), "   ")
    padded = F.concat(F.lit("  "), words, F.lit(" "))
    return F.array_distinct(
        F.regexp_extract_all(padded, F.lit(r"(?s)(?=(.[^ ].|  [^ ]))"), F.lit(1))
    )


def trigram_codes(c: Column) -> Column:
    """The trigrams as longs: three code points of 21 bits each, so equal codes = equal text."""

    def code(t: Column) -> Column:
        point = [F.ascii(F.substring(t, i, 1)).cast("long") for i in (1, 2, 3)]
        return (
            F.shiftleft(point[0], 42).bitwiseOR(F.shiftleft(point[1], 21)).bitwiseOR(point[2])
        )

    return F.transform(trigrams(c), code)


def set_similarity(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays of distinct items; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def match_confidence(identifier: Column, name: Column, address: Column) -> Column:
    """Blend of the signals, clamped to 0..1 and rounded half up to 4 places."""
    raw = (
        F.when(identifier, F.lit(1.0))
        .when(
            name.isNotNull() & address.isNotNull(),
            F.lit(K.WEIGHT_NAME) * name + F.lit(K.WEIGHT_ADDRESS) * address,
        )
        .when(name.isNotNull(), name * K.NAME_ALONE)
        .when(address.isNotNull(), address * K.ADDRESS_ALONE)
        .otherwise(F.lit(0.0))
    )
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))
    return F.floor(clamped * 10000 + F.lit(0.5)).cast("double") / 10000


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def csv_escape(c: Column) -> Column:
    """Quote a field when it holds a quote, comma or line feed."""
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[",\n]'), quoted).otherwise(c)
