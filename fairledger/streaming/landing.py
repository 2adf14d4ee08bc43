"""Continuous landing: new files are landed, ingested, versioned and profiled as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairledger.operators import versions as V
from fairledger.plans.jobs import profile_job, write_profiled
from fairledger.plans.staging import stage
from fairledger.scope import VERSION
from fairledger.sources import landing
from fairledger.sources.delimited import ingest

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


#: What a row can hold; larger files are listed as failed and never read.
LARGEST = 2**31 - 1


def _arrived(files: DataFrame, tenant_id: str, project_id: str, most: int) -> DataFrame:
    """Files of one batch; the dataset is the folder's name, the version id follows the content.

    The content of files beyond `most` bytes is not read; place, size and time stand for it.
    """
    parts = F.split("path", "/")
    names = [
        F.lit(tenant_id).alias("tenant_id"), F.lit(project_id).alias("project_id"),
        F.element_at(parts, -2).alias("dataset_name"),
        F.element_at(parts, -1).alias("filename"),
        F.col("modificationTime").alias("arrived_at"), "length",
    ]
    fit = landing.keyed(files.where(F.col("length") <= most).select(*names, "content"))
    place = F.sha2(F.concat_ws("/", "path", F.col("length").cast("string"),
                               F.col("modificationTime").cast("string")), 256)
    over = files.where(F.col("length") > most).select(
        *names, F.lit(None).cast("binary").alias("content"), place.alias("checksum")
    ).withColumn("storage_key", landing.storage_key(
        F.col("tenant_id"), F.col("checksum"), F.col("filename")))
    return fit.unionByName(over).withColumn(
        "dataset_version_id",
        F.sha2(F.concat_ws("/", "project_id", "dataset_name", "storage_key"), 256),
    )


def process_batch(
    files: DataFrame, folder: str, tenant_id: str, project_id: str,
    max_bytes: int | None = None, max_rows: int | None = None,
) -> None:
    """One batch. Every table is written by version, so a batch that is taken again, whole or after
    it was lost half-way, leaves the same rows as if it had been taken once."""
    spark = files.sparkSession
    most = LARGEST if max_bytes is None else min(max_bytes, LARGEST)
    arrived = _arrived(files, tenant_id, project_id, most)
    known = f"{folder}/dataset_versions"
    have = spark.read.parquet(known) if landing._exists(spark, known) else None
    if have is not None:
        arrived = arrived.join(
            have.select("tenant_id", "dataset_version_id"),
            ["tenant_id", "dataset_version_id"], "left_anti",
        )
    batch = stage(arrived.dropDuplicates(["tenant_id", "dataset_version_id"]))
    if batch.isEmpty():
        return
    landing.land(
        batch.where(F.col("content").isNotNull()).drop("checksum", "storage_key"), f"{folder}/raw")
    parsed = ingest(batch, most, max_rows)
    taken = stage(parsed.runs.select(*VERSION, "status"))
    done = taken.where(F.col("status") == "completed").select(*VERSION)
    write_profiled(profile_job(parsed.rows, parsed.columns, versions=done), folder)
    landing.replace_versions(parsed.rejected, done, f"{folder}/rejected_rows")
    landing.replace_versions(parsed.runs, taken, f"{folder}/ingestion_runs")
    columns = [*V.DATASET, "dataset_version_id", "arrived_at"]
    arrivals = batch.join(done, VERSION, "left_semi").select(*columns)
    if have is None:
        have = arrivals.limit(0).withColumn("version_number", F.lit(0).cast("long"))
    registered = V.register(arrivals, have)
    # Last of all: until this is written the batch counts as not done and is taken again.
    stage(registered).write.mode("append").parquet(known)


def landing_stream(
    spark: SparkSession, inbox: str, folder: str, checkpoint: str, tenant_id: str,
    project_id: str, max_bytes: int | None = None, max_rows: int | None = None,
):
    """Start the stream over `inbox/<dataset>/<file>`; stops when all present files are done."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(inbox)
    )
    return (
        files.writeStream.foreachBatch(
            lambda df, _: process_batch(df, folder, tenant_id, project_id, max_bytes, max_rows)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
