"""Partners with what belongs to them, and checks of child rows against their parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.operators.matching import PAIR

ADDRESS = ["address_type", "line1", "line2", "city", "region", "postal_code", "country_code",
           "is_primary"]
IDENTIFIER = ["identifier_type", "identifier_value", "issuing_authority"]
RELATIONSHIP = ["related_business_partner_id", "relationship_type", "provenance"]
SUPPLIER = ["supplier_number", "source_system", "status"]
SECTIONS = {
    "address": ADDRESS, "identifier": IDENTIFIER, "relationship": RELATIONSHIP,
    "supplier": SUPPLIER,
}


def child_rows(**tables: DataFrame) -> DataFrame:
    """Children of all kinds as one table: (tenant, partner, section, child id, time, body).

    One row per child rather than one array per partner, so that a partner with very many children
    is no larger for any task than its rows are. `body` is the child as JSON.
    """
    parts = []
    for section, df in tables.items():
        have = [c for c in SECTIONS[section] if c in df.columns]
        parts.append(df.select(
            "tenant_id", "business_partner_id", F.lit(section).alias("section"),
            F.col("id").alias("child_id"), "created_at",
            F.to_json(F.struct(*have), {"ignoreNullFields": "false"}).alias("body"),
        ))
    return reduce(DataFrame.unionByName, parts)


def detail(partners: DataFrame, children: DataFrame) -> DataFrame:
    """Each partner with its children, oldest first; a partner without any has one empty row."""
    base = partners.select(
        "tenant_id", "project_id", F.col("id").alias("business_partner_id"), "primary_name"
    )
    return base.join(children, ["tenant_id", "business_partner_id"], "left").orderBy(
        "tenant_id", "business_partner_id", "section", "created_at", "child_id"
    )


def pair_view(matches: DataFrame, partners: DataFrame, children: DataFrame) -> DataFrame:
    """Both sides of each match, one row per side and child."""
    sides = matches.select(
        *PAIR, F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col("business_partner_id").alias("partner_id")),
            F.struct(
                F.lit("b").alias("side"),
                F.col("candidate_business_partner_id").alias("partner_id"),
            ),
        )).alias("s"),
    ).select(*PAIR, "s.side", "s.partner_id")
    named = partners.select("tenant_id", F.col("id").alias("partner_id"), "primary_name")
    owned = children.withColumnRenamed("business_partner_id", "partner_id")
    return sides.join(named, ["tenant_id", "partner_id"]).join(
        owned, ["tenant_id", "partner_id"], "left"
    )


def check_children(
    children: DataFrame, partners: DataFrame, parent: str = "business_partner_id"
) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason): a child needs an existing parent of its own tenant."""
    ids = partners.select("tenant_id", F.col("id").alias(parent))
    on = ["tenant_id", parent]
    rejected = children.join(ids, on, "left_anti").withColumn(
        "reason", F.lit("Business partner not found")
    )
    return children.join(ids, on, "left_semi"), rejected


def check_relationships(
    relationships: DataFrame, partners: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason): both ends must exist and differ."""
    one = F.lit(1)
    source = partners.select(
        "tenant_id", F.col("id").alias("business_partner_id"), one.alias("s")
    )
    target = partners.select(
        "tenant_id", F.col("id").alias("related_business_partner_id"), one.alias("t")
    )
    reason = (
        F.when(
            F.col("business_partner_id") == F.col("related_business_partner_id"),
            "A business partner cannot have a relationship to itself",
        )
        .when(F.col("s").isNull(), "Business partner not found")
        .when(F.col("t").isNull(), "related business partner not found")
    )
    judged = (
        relationships.join(source, ["tenant_id", "business_partner_id"], "left")
        .join(target, ["tenant_id", "related_business_partner_id"], "left")
        .withColumn("reason", reason)
        .drop("s", "t")
    )
    ok = judged.where(F.col("reason").isNull()).drop("reason")
    return ok, judged.where(F.col("reason").isNotNull())


def newest_first(df: DataFrame) -> DataFrame:
    """Lists of one project: newest first, id settles ties."""
    return df.orderBy(F.desc("created_at"), "id")
