"""Row rules: allowed values, ranges, order of pairs, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairledger.functions import fixed as K


def one_of(column: str, allowed: list[str]) -> tuple[str, Column]:
    return f"{column} is not one of its allowed values", F.col(column).isin(allowed)


def in_range(column: str, low: float, high: float) -> tuple[str, Column]:
    return f"{column} is outside {low}..{high}", F.col(column).between(low, high)


def differ(a: str, b: str) -> tuple[str, Column]:
    return f"{a} equals {b}", F.col(a) != F.col(b)


def ordered(a: str, b: str) -> tuple[str, Column]:
    return f"{a} is not before {b}", F.col(a) < F.col(b)


def match_rules() -> list[tuple[str, Column]]:
    return [
        one_of("match_method", ["exact", "fuzzy"]),
        in_range("confidence", 0, 1),
        one_of("decision", K.DECISIONS),
        differ("business_partner_id", "candidate_business_partner_id"),
        ordered("business_partner_id", "candidate_business_partner_id"),
    ]


def supplier_rules() -> list[tuple[str, Column]]:
    return [one_of("status", K.SUPPLIER_STATUSES)]


def partner_rules() -> list[tuple[str, Column]]:
    return [one_of("bp_type", K.BP_TYPES)]


def check(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Add `reasons`: the rules a row breaks. As in a table check, null breaks nothing."""
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(text)) for text, ok in rules]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def split(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons)."""
    checked = check(df, rules)
    bad = F.size("reasons") > 0
    return checked.where(~bad).drop("reasons"), checked.where(bad)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a null in them never do."""
    return (
        df.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"))
        .where("occurrences > 1")
    )
