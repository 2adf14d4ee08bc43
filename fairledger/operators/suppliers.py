"""Duplicate supplier records of a partner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.plans.staging import stage

OWNER = ["tenant_id", "business_partner_id"]


def check(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Mark each incoming record: blocked as an exact copy, or flagged for its source system.

    Incoming rows carry `id` and `created_at` and are taken in that order. The same partner, source
    system and number, all given, block. Another record of the same source system only flags.
    Firsts come from groupings that are written and joined back, so no group is gathered however
    large it is, and Spark can split a large one in the join.
    """
    order = F.struct("created_at", "id")
    full, source = [*OWNER, "source_system", "supplier_number"], [*OWNER, "source_system"]
    marked = incoming.withColumn("order", order)
    kind = marked.schema["order"].dataType
    both = existing.select(
        *full, F.lit(True).alias("known"), F.lit(None).cast(kind).alias("order")
    ).unionByName(marked.select(*full, F.lit(False).alias("known"), "order"))

    def firsts(key: list[str], what: str) -> DataFrame:
        return stage(
            both.dropna(subset=key).groupBy(*key)
            .agg(F.max("known").alias(f"known_{what}"), F.min("order").alias(f"first_{what}"))
        )

    joined = marked.join(firsts(full, "copy"), full, "left").join(
        firsts(source, "source"), source, "left"
    )
    never = F.lit(False)
    blocked = F.coalesce("known_copy", never) | F.coalesce(
        F.col("first_copy") < F.col("order"), never
    )
    seen = F.coalesce("known_source", never) | F.coalesce(
        F.col("first_source") < F.col("order"), never
    )
    flagged = ~blocked & seen & (F.coalesce("source_system", F.lit("")) != "")
    return joined.select(
        *incoming.columns,
        F.when(blocked, "blocked").when(flagged, "flagged").otherwise("ok").alias("outcome"),
    )


def duplicate_sources(suppliers: DataFrame) -> DataFrame:
    """Source systems that list a partner more than once, one row each."""
    return (
        suppliers.where(F.coalesce("source_system", F.lit("")) != "")
        .groupBy(*OWNER, "source_system")
        .agg(F.count(F.lit(1)).alias("records"))
        .where("records > 1")
    )
