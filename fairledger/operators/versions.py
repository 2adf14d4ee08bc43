"""Datasets and their numbered versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.operators.numbering import number_in_order
from fairledger.plans.staging import stage

DATASET = ["tenant_id", "project_id", "dataset_name"]


def latest(versions: DataFrame) -> DataFrame:
    """The version with the highest number of each dataset."""
    rest = [c for c in versions.columns if c not in (*DATASET, "version_number")]
    return (
        versions.groupBy(*DATASET)
        .agg(F.max(F.struct("version_number", *rest)).alias("v"))
        .select(*DATASET, "v.*")
    )


def register(arrivals: DataFrame, existing: DataFrame) -> DataFrame:
    """New version rows for arrived files, numbered on from what exists, with their parents.

    arrivals: DATASET, dataset_version_id, arrived_at (ties are settled by the id). A name not seen
    before in its project starts a dataset at version 1.
    """
    numbered = number_in_order(arrivals, DATASET, ["arrived_at", "dataset_version_id"], "nth")
    last = stage(latest(existing.select(*DATASET, "version_number", "dataset_version_id")).select(
        *DATASET, F.col("version_number").alias("last_number"),
        F.col("dataset_version_id").alias("last_id"),
    ))
    new = (
        numbered.join(last, DATASET, "left")
        .withColumn("version_number", F.col("nth") + F.coalesce("last_number", F.lit(0)))
    )
    parent = new.select(
        *DATASET, (F.col("nth") + 1).alias("nth"),
        F.col("dataset_version_id").alias("parent_version_id"),
    )
    return new.join(parent, [*DATASET, "nth"], "left").select(
        *arrivals.columns, "version_number",
        F.coalesce(
            "parent_version_id", F.when(F.col("nth") == 1, F.col("last_id"))
        ).alias("parent_version_id"),
    )


def history(versions: DataFrame) -> DataFrame:
    return versions.orderBy(*DATASET, F.desc("version_number"))
