"""Semantic type of a column, and the queue of columns that rules cannot type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.functions.text import shape
from fairledger.operators.cells import has, values_at
from fairledger.plans.staging import stage
from fairledger.scope import COLUMN


def semantic_type(name: Column, inferred: Column) -> Column:
    """First rule that holds: value patterns, then hints in the name. Needs `column_votes`."""
    low = F.lower(name)

    def mostly(flag: str) -> Column:
        return F.col(flag) / F.col("filled") >= K.VALUE_SHARE

    chain = (
        F.when(F.coalesce(F.col("filled"), F.lit(0)) == 0, None)
        .when(mostly("m_email"), "email")
        .when(mostly("m_url"), "url")
        .when(mostly("m_currency"), "currency_code")
        .when(low.rlike(K.COUNTRY_HINT) & mostly("m_country"), "country_code")
        .when(low.rlike(K.PHONE_HINT) & mostly("m_phone"), "phone_number")
        .when(
            low.rlike(K.PERCENT_HINT) & inferred.isin("integer", "decimal") & mostly("m_percent"),
            "percentage",
        )
    )
    for type_, hint, allowed in K.NAME_RULES:
        rule = low.rlike(hint)
        chain = chain.when(rule if allowed is None else rule & inferred.isin(allowed), type_)
    return chain.otherwise(None)


def infer(columns: DataFrame, facts: DataFrame) -> DataFrame:
    inferred = F.coalesce(F.col("inferred_type"), F.lit("string"))
    return columns.join(facts, COLUMN, "left").select(
        *COLUMN, "column_name", inferred.alias("inferred_type"),
        semantic_type(F.col("column_name"), inferred).alias("semantic_type"),
        F.coalesce("filled", F.lit(0)).alias("filled"),
    )


def shape_samples(rows: DataFrame, counts: DataFrame, limit: int = K.QUEUE_SHAPES) -> DataFrame:
    """The first distinct shapes of each column, in order of first appearance.

    `row_number() <= limit` lets Spark drop all but `limit` shapes per column in every task before
    the shuffle, so a free-text column does not send its shapes to one place. Until then shapes are
    digests; the texts of those that are left are looked up in their first rows.
    """
    shapes = counts.where(has("filled")).groupBy(*COLUMN, "s1", "s2").agg(
        F.min("first_row").alias("first_row"))
    order = Window.partitionBy(*COLUMN).orderBy("first_row", "s1", "s2")
    first = stage(shapes.withColumn("ordinal", F.row_number().over(order)).where(
        F.col("ordinal") <= limit))
    return values_at(rows, first).select(
        *COLUMN, shape(F.col("value")).alias("shape"), "first_row", "ordinal")


def review_queue(typed: DataFrame, samples: DataFrame) -> DataFrame:
    """Untyped columns that have values, with shapes only: raw values never leave."""
    open_ = typed.where(F.col("semantic_type").isNull() & (F.col("filled") > 0))
    per_column = samples.groupBy(*COLUMN).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "shape"))).alias("s")
    )
    return open_.join(per_column, COLUMN).select(
        *COLUMN, "column_name", "inferred_type", F.col("s.shape").alias("sample_shapes")
    )
