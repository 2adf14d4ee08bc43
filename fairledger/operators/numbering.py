"""Consecutive numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairledger.plans.staging import stage


def number_in_order(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """1, 2, 3, ... within each group by `order`, which must be unique there.

    Rows are range-partitioned by group and order, so one large group spreads over many slabs. The
    slab of a row is written with it; row numbers within slabs plus the sizes of the slabs before
    give the number. No window spans more than one slab, or one row per slab.
    """
    ranged = stage(
        df.repartitionByRange(*group, *order).withColumn("_slab", F.spark_partition_id())
    )
    before = Window.partitionBy(*group).orderBy("_slab").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = ranged.groupBy(*group, "_slab").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *group, "_slab", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*group, "_slab").orderBy(*order)
    return (
        ranged.join(offsets, [*group, "_slab"])
        .withColumn(out, F.row_number().over(within) + F.col("_offset"))
        .drop("_slab", "_offset")
    )
