"""Steward decisions on matches, applied in bulk.

A merge is only recorded, never carried out, and needs the "approve" permission. A refused merge
leaves the match alone and is itself an audit event.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.operators.audit import events
from fairledger.operators.matching import PAIR


def role_has(role: Column, permission: str) -> Column:
    return role.isin([r for r, p in K.ROLE_PERMISSIONS.items() if permission in p])


@dataclass
class Outcome:
    judged: DataFrame  # every decision with its outcome
    matches: DataFrame  # the match table afterwards
    audit: DataFrame


def judge(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of each decision: ok, invalid, forbidden, merge_denied or not_found.

    decisions: PAIR, decision, user_id, role, decided_at.
    """
    known = matches.select(*PAIR, F.col("decision").alias("old_decision"))
    outcome = (
        F.when(~role_has(F.col("role"), "modify"), "forbidden")
        .when(~F.col("decision").isin(K.DECISIONS) | F.col("decision").isNull(), "invalid")
        .when(
            (F.col("decision") == "merge") & ~role_has(F.col("role"), "approve"), "merge_denied"
        )
        .when(F.col("old_decision").isNull(), "not_found")
        .otherwise("ok")
    )
    return decisions.join(known, PAIR, "left").withColumn("outcome", outcome)


def apply(matches: DataFrame, decisions: DataFrame) -> Outcome:
    """Apply all allowed decisions; of several on one pair the last by time stands."""
    judged = judge(matches, decisions)
    ok = judged.where(F.col("outcome") == "ok")
    last = ok.groupBy(*PAIR).agg(
        F.max(F.struct("decided_at", "user_id", "decision")).alias("new")
    )
    rest = [c for c in matches.columns if c not in (*PAIR, "decision", "decided_by", "decided_at")]
    updated = matches.join(last, PAIR, "left").select(
        *PAIR, *rest,
        F.coalesce("new.decision", "decision").alias("decision"),
        F.coalesce("new.user_id", "decided_by").alias("decided_by"),
        F.coalesce("new.decided_at", "decided_at").alias("decided_at"),
    )
    # What a decision replaces is the allowed one before it on the same pair, else the stored one.
    before = Window.partitionBy(*PAIR).orderBy("decided_at", "user_id", "decision")
    ok = ok.withColumn(
        "old_decision", F.coalesce(F.lag("decision").over(before), F.col("old_decision")))
    entity = F.concat_ws("::", "business_partner_id", "candidate_business_partner_id")
    recorded = events(
        ok, "entity_match.decision_recorded", "EntityMatch", entity_id=entity,
        actor_user_id=F.col("user_id"),
        old_value=F.to_json(F.struct(F.col("old_decision").alias("decision"))),
        new_value=F.to_json(F.struct("decision")),
    )
    denied = events(
        judged.where(F.col("outcome") == "merge_denied"),
        "entity_match.merge_denied", "EntityMatch", entity_id=entity,
        actor_user_id=F.col("user_id"),
        new_value=F.to_json(F.struct(F.lit("merge").alias("attemptedDecision"), "role")),
    )
    return Outcome(judged, updated, recorded.unionByName(denied))
