"""From raw documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's documents. Stages read only doc_id, text and source of the documents and pass on their
other columns, whatever their names and types. Each decides for each row by its own text, whether
its doc_id is null or repeated. Of a group of near copies one row stays. The last stage adds size,
checksum, row number, shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fairledger.llm import decontam, jaccard_join, mixing, sharding, toxicity
from fairledger.plans.staging import folder

SHARDS, MIX_SEED, SHARD_SEED = 16, 17, 29
NGRAM, SIMILARITY, CONTAINMENT = 5, (4, 5), (4, 5)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest id stays, or one of those without id."""
    return jaccard_join.without_near_copies(docs, NGRAM, SIMILARITY)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.without_items(docs, _table(spark, sf_dir, "benchmark"), NGRAM, CONTAINMENT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents."""
    return mixing.mixed_rows(docs, seed=MIX_SEED)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, with the columns of documents."""
    return sharding.shard(docs, SHARDS, SHARD_SEED, whole=True)


STAGES = [
    ("toxicity", toxic_out),
    ("n-gram Jaccard join", near_copies_out),
    ("benchmark decontamination", leaks_out),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: Training, the seeded order by hash and the permutation have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs, base = _table(spark, sf_dir, "documents"), f"{folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, make) in enumerate(STAGES):
        make(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
