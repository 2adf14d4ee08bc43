"""Landing of raw files by content, and table sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairledger.scope import VERSION

MARK = "is_marker"


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def storage_key(tenant: Column, checksum_: Column, filename: Column) -> Column:
    safe = F.regexp_replace(filename, "[^a-zA-Z0-9._-]", "_")
    return F.concat(tenant, F.lit("/"), checksum_, F.lit("-"), safe)


def keyed(files: DataFrame) -> DataFrame:
    """Files with checksum and key; equal bytes under an equal name give one key."""
    return files.withColumn("checksum", checksum(F.col("content"))).withColumn(
        "storage_key", storage_key(F.col("tenant_id"), F.col("checksum"), F.col("filename"))
    )


def new_files(files: DataFrame, landed: DataFrame | None) -> DataFrame:
    """One file per key that has not landed yet."""
    unseen = keyed(files)
    if landed is not None:
        unseen = unseen.join(landed.select("storage_key"), "storage_key", "left_anti")
    return unseen.dropDuplicates(["storage_key"])


def land(files: DataFrame, path: str) -> None:
    """Append the files that are new; what has landed is never rewritten."""
    spark = files.sparkSession
    landed = None
    if _exists(spark, path):
        landed = spark.read.parquet(path)
    new_files(files, landed).write.mode("append").partitionBy("tenant_id").parquet(path)


def _exists(spark, path: str) -> bool:
    """Is there a table; any fault but a missing path or an empty folder is raised."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as fault:
        if fault.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def replace_versions(df: DataFrame, versions: DataFrame, path: str) -> None:
    """Replace all rows of the given versions, and only those.

    A marker row per version makes sure that a version with no rows any more loses its old ones.
    Versions are written whole by few tasks, large ones by several.
    """
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in VERSION]
    markers = versions.select(*VERSION).distinct().select(*VERSION, *none, F.lit(True).alias(MARK))
    df.withColumn(MARK, F.lit(False)).unionByName(markers).hint("rebalance", *VERSION).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy(*VERSION).parquet(path)


def read_versions(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).where(~F.col(MARK)).drop(MARK)
