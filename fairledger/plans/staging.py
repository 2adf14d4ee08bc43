"""Cutting lineage through tables written to the cluster's shared checkpoint folder.

A written table survives the loss of executors, is computed once however often it is read, and has
a size Spark knows: the planner then broadcasts it only when it is under
`spark.sql.autoBroadcastJoinThreshold` and shuffles it otherwise. Adaptive execution splits a hot
key only where both sides of a join come straight from a shuffle. A grouping does not, once it is
written it does: groupings that are joined back to their rows are therefore staged first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_named: dict[str, str] = {}
_staged: list[str] = []


def use_folder(path: str) -> None:
    """The folder of sessions on one machine that do not name one, as in tests."""
    _named["path"] = path


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in `spark.checkpoint.dir`."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not named and spark.sparkContext.master.startswith("local"):
        named = _named.get("path")
    if not named:
        raise ValueError(f"set {SETTING} to a folder that all executors can reach")
    return named.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table."""
    path = f"{folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession) -> int:
    """Delete the tables this process has staged so far, once what was made of them is written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        done += path.getFileSystem(conf).delete(path, True)
    return done
