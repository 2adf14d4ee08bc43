"""Column expressions against hand-made cases."""

import pytest
from pyspark.sql import functions as F

from fairledger.functions import text as T


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,expected", [
    ("12", "integer"), (" -7 ", "integer"), ("1.5", "decimal"), ("1.", "string"), ("Y", "boolean"),
    ("FALSE", "boolean"), ("2024-01-15", "date"), ("2024-01-15T10:20", "date"),
    ("1/2/2024", "date"), ("1/2/24", "string"), ("", "string"), ("12\n", "integer"),
    ("1d", "string"), (" 42﻿", "integer"),
])
def test_classify(spark, value, expected):
    assert one(spark, value, T.classify_value) == expected


@pytest.mark.parametrize("value,type_,expected", [
    ("007", "integer", False), ("0", "integer", True), ("1.50", "decimal", True),
    ("1.5", "decimal", False), ("03/02/2024", "date", False), ("True", "boolean", True),
    ("yes", "boolean", False), (" x", "string", False), ("x y", "string", True),
])
def test_strict_form(spark, value, type_, expected):
    assert one(spark, value, lambda c: T.conforms_strictly(c, F.lit(type_))) is expected


def test_shape_merges_digits_and_letters(spark):
    assert one(spark, "2024-01-15", T.shape) == "A-A-A"
    assert one(spark, "AB12", T.shape) == "A"


@pytest.mark.parametrize("value,expected", [
    ("1e5", 100000.0), (".5", 0.5), ("5.", 5.0), ("+3", 3.0), ("1d", None), ("NaN", None),
    ("Infinity", None), ("1e999", None), ("1e-400", 0.0), ("12abc", None), ("1e250", 1e250),
    ("1.7e308", 1.7e308), ("9" * 250, 1e250), ("-1e308", -1e308), ("1e309", None),
])
def test_numbers(spark, value, expected):
    assert one(spark, value, T.to_number) == expected


@pytest.mark.parametrize("value", [
    "Acme Corp", "Acme Corp.", "ACME CORPORATION", "  acme   corp  ", "Acme, Corp"
])
def test_name_key(spark, value):
    assert one(spark, value, T.name_match_key) == "ACME"


def test_more_keys(spark):
    assert one(spark, "Stark Industries Ltd", T.name_match_key) == "STARK INDUSTRIES"
    assert one(spark, None, T.normalize_display_text) == ""
    assert one(spark, " sw1a 1aa ", T.normalize_postal_code) == "SW1A1AA"
    for v in ("12-3456789", "12.3456789", "12 3456789", "12/3456789", "123456789"):
        assert one(spark, v, T.identifier_match_key) == "123456789"
    assert one(spark, "- . /", T.identifier_match_key) == ""


def test_address_key(spark):
    df = spark.createDataFrame([
        ("1 Infinite Loop", "Cupertino", "95014", "us"),
        ("  1   infinite loop.", "CUPERTINO", "95 014", "US"),
        ("500 Oracle Pkwy", "Redwood City", "94065", "US"),
    ], "a string, b string, c string, d string")
    keys = [r[0] for r in df.select(T.address_match_key(*map(F.col, "abcd"))).collect()]
    assert keys[0] == keys[1] != keys[2]


@pytest.mark.parametrize("a,b,expected", [
    ("Acme Corp", "Acme Corporation", 0.5), ("Globex Corporation", "Globex Corp", 0.55),
    ("Wayne Enterprises", "Wayne Enterprizes", 0.714), ("Acme Corp", "Ajax Corp", 0.428),
    ("Stark Industries", "Umbrella Corp", 0.0), ("", "x", 0.0),
])
def test_trigram_similarity(spark, a, b, expected):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    plain, coded = df.select(
        T.trigram_similarity(F.col("a"), F.col("b")),
        T.set_similarity(T.trigram_codes(F.col("a")), T.trigram_codes(F.col("b"))),
    ).first()
    assert plain == coded == pytest.approx(expected, abs=6e-4)


@pytest.mark.parametrize("ident,name,address,expected", [
    (False, 0.8, 0.6, 0.73), (False, 0.9, None, 0.765), (False, None, 0.9, 0.63),
    (True, 0.2, None, 1.0), (False, None, None, 0.0),
])
def test_confidence(spark, ident, name, address, expected):
    df = spark.createDataFrame([(ident, name, address)], "i boolean, n double, a double")
    assert df.select(
        T.match_confidence(F.col("i"), F.col("n"), F.col("a"))
    ).first()[0] == pytest.approx(expected)


def test_csv_escape(spark):
    assert one(spark, 'a "b"', T.csv_escape) == '"a ""b"""'
    assert one(spark, "a b", T.csv_escape) == "a b"


def test_repeated_words_are_cut_once(spark):
    text = ("Ab ab, AB c!  " * 50_000) + "é ß"
    df = spark.createDataFrame([(text,), (" ,a,,a ",), ("",), ("...",), (None,)], "t string")
    got = [r[0] for r in df.select(T.trigrams(F.col("t"))).collect()]
    assert got == [["  a", " ab", "ab ", "  c", " c ", "  é", " é ", "  ß", " ß "], ["  a", " a "], [], [], None]
    plan = df.select(T.trigrams(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("array_distinct(split")  # inside of it
