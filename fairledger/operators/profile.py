"""Column profiles, dataset scores and project scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.operators.cells import MARKS, has, marked, merged_cells, value_counts
from fairledger.scope import COLUMN, PROJECT, VERSION


COUNTED = {
    **{m: (m,) for m in MARKS if m != "strict"},
    **{f"c_{t}": (f"n_{t}", "strict") for t in K.TYPES[:-1]},
}


def _sums() -> list[Column]:
    """How often each fact holds; conforming text is text without outer blanks."""
    sums = [F.sum(F.when(has(*m), F.col("n")).otherwise(0)).alias(k) for k, m in COUNTED.items()]
    return [*sums, F.sum(F.when(has("n_string"), F.col("n_untouched")).otherwise(0)).alias("c_string")]


def column_votes(rows: DataFrame) -> DataFrame:
    """Counts by type and pattern of every column, from cells grouped by their facts alone.

    A column has few combinations of facts, so a task sends a handful of rows for it. What needs
    no distinct values (types, semantic types) is answered from here.
    """
    by_facts = marked(merged_cells(rows)).groupBy(*COLUMN, "marks").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("raw") == F.col("value"), F.col("n")).otherwise(0)).alias("n_untouched"))
    return by_facts.groupBy(*COLUMN).agg(F.sum("n").alias("row_count"), *_sums()).withColumn(
        "inferred_type", majority_type())


def column_facts(counts: DataFrame) -> DataFrame:
    """All counts that a column's profile, type and semantic type are derived from.

    Two grouping steps over digests: by shape, then by column. Counts a caller does not use are
    pruned. `dominant_row` is the first row with the commonest shape, of several the earliest.
    """
    by_shape = counts.groupBy(*COLUMN, "s1", "s2").agg(
        F.sum("n").alias("shape_n"),
        F.count(F.lit(1)).alias("shape_distinct"),
        F.min("first_row").alias("shape_first"),
        *_sums(),
    )
    filled = F.col("filled") > 0
    top = F.max(F.when(filled, F.struct(
        F.col("shape_n"), (-F.col("shape_first")).alias("first"), F.col("s1"), F.col("s2"))))
    facts = by_shape.groupBy(*COLUMN).agg(
        F.sum("shape_n").alias("row_count"),
        F.sum(F.when(filled, F.col("shape_distinct")).otherwise(0)).alias("distinct_count"),
        top.getField("shape_n").alias("dominant_n"),
        (-top.getField("first")).alias("dominant_row"),
        top.getField("s1").alias("dominant_s1"), top.getField("s2").alias("dominant_s2"),
        *[F.sum(k).alias(k) for k in [*COUNTED, "c_string"]],
    )
    return facts.withColumn("inferred_type", majority_type())


def majority_type() -> Column:
    """The type that more than half of the filled cells have, else string."""
    chosen = F
    for t in K.TYPES[:-1]:
        chosen = chosen.when(F.col(f"n_{t}") * 2 > F.col("filled"), t)
    return chosen.otherwise("string")


def of_type(prefix: str) -> Column:
    return F.coalesce(*[
        F.when(F.col("inferred_type") == t, F.col(f"{prefix}_{t}")) for t in K.TYPES
    ])


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def field_profiles(columns: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts, the five dimensions and the quality score of every column, also of empty ones."""
    joined = columns.join(facts, COLUMN, "left")
    number = {"row_count", "filled", "distinct_count", "dominant_n"}
    number |= {f"{p}_{t}" for p in "nc" for t in K.TYPES}
    known = joined.select(
        *COLUMN, "column_name",
        F.coalesce("inferred_type", F.lit("string")).alias("inferred_type"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in sorted(number)],
    )
    total, filled = F.col("row_count"), F.col("filled")
    scored = known.select(
        *COLUMN, "column_name", "inferred_type", "row_count",
        (total - filled).alias("null_count"),
        "distinct_count",
        _share(filled, total, 1.0).alias("completeness"),
        _share(F.col("distinct_count"), filled, 0.0).alias("uniqueness"),
        _share(of_type("n"), filled, 1.0).alias("validity"),
        _share(of_type("c"), filled, 1.0).alias("conformity"),
        _share(F.col("dominant_n"), filled, 1.0).alias("consistency"),
    )
    dims = ["completeness", "validity", "conformity", "consistency"]
    return scored.withColumn("quality_score", sum(F.col(d) for d in dims) / len(dims))


def profile(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Field profiles straight from rows."""
    return field_profiles(columns, column_facts(value_counts(rows)))


def dataset_profiles(versions: DataFrame, fields: DataFrame) -> DataFrame:
    """Row count, column count and mean field quality per version (1 when it has no columns)."""
    per_version = fields.groupBy(*VERSION).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.avg("quality_score").alias("overall_quality_score"),
    )
    return versions.select(*VERSION).join(per_version, VERSION, "left").select(
        *VERSION,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        F.coalesce("overall_quality_score", F.lit(1.0)).alias("overall_quality_score"),
    )


def dataset_scores(latest: DataFrame, profiles: DataFrame) -> DataFrame:
    """Latest version of each dataset with its score, null while it is not profiled."""
    scores = profiles.select("tenant_id", "dataset_version_id", "overall_quality_score")
    return latest.join(scores, ["tenant_id", "dataset_version_id"], "left")


def project_scores(scored: DataFrame) -> DataFrame:
    """Mean over the profiled latest versions; null, not 0, when there are none."""
    return scored.groupBy(*PROJECT).agg(
        F.count(F.lit(1)).alias("dataset_count"),
        F.count("overall_quality_score").alias("profiled_dataset_count"),
        F.avg("overall_quality_score").alias("overall_quality_score"),
    )


def fields_by_name(fields: DataFrame) -> DataFrame:
    return fields.orderBy(*VERSION, "column_name", "col_idx")
