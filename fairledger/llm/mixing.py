"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

The mix has a fixed number of words, cut into equal blocks. The blocks go to the sources one by one
by the highest quotient target / (2 k + 1), k being the blocks a source already has. The sequence of
awards is cut into as many equal runs as there are shards, so every shard gets integer quotas too;
as the method never takes a block back when there is one more, they are differences of two results.
A source's documents lie in an order drawn by the seed, end to end, and again for each repetition;
its first blocks in that order are taken, whole or in part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairledger.plans.staging import stage

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK_WORDS = 64
SHARDS = 16
#: What a word is.
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2 k + 1); of equal ones the earlier entry wins.

    All seats with a quotient above that of a divisor which surely leaves some over are given at
    once; at most twice the number of entries are then given one by one.
    """
    votes = np.asarray(votes, float)
    given = np.zeros(len(votes), np.int64)
    if seats <= 0 or not votes.sum():
        return given
    if seats > 2 * len(votes):
        given = np.floor(votes * ((seats - 2 * len(votes)) / votes.sum()) + 0.5).astype(np.int64)
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, given)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heap[0]
        given[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def targets(sizes: np.ndarray, weights: np.ndarray, repeats: int) -> np.ndarray:
    """Shares of sum(sizes) by weight, none above `repeats` times its size.

    What is above goes to the others by weight. Sources reach their bound in the order of
    bound / weight, so the number of bounded ones is found in one pass over that order.
    """
    bound = sizes * repeats
    order = np.argsort(bound / weights, kind="stable")
    out = np.zeros(len(sizes))
    rest, left = int(sizes.sum()), int(weights.sum())
    for at, i in enumerate(order):
        if weights[i] * rest <= bound[i] * left:
            free = order[at:]
            out[free] = weights[free] * rest / left
            break
        out[i] = bound[i]
        rest -= int(bound[i])
        left -= int(weights[i])
    return out


def plan(
    sources: pd.DataFrame, block_words: int, repeats: int, shards: int,
) -> pd.DataFrame:
    """Target and quotas of each source; `quotas` counts the blocks of all shards up to each."""
    key = [(s is None, s or "") for s in sources["source"]]
    sources = sources.iloc[sorted(range(len(key)), key=key.__getitem__)].reset_index(drop=True)
    sizes = sources["source_size"].to_numpy(np.int64)
    weights = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))], np.int64)
    goal = targets(sizes, weights, repeats)
    blocks = -(-int(sizes.sum()) // block_words)
    quotas = np.array([sainte_lague(goal, blocks * (s + 1) // shards) for s in range(shards)])
    return sources.assign(
        target=goal, blocks=quotas[-1] if len(sizes) else [],
        quotas=list(quotas.T.tolist()) if len(sizes) else [],
    )


def mix(
    docs: DataFrame, block_words: int = BLOCK_WORDS, repeats: int = REPEATS, shards: int = SHARDS,
    seed: int = 0, id: str = "doc_id", text: str = "text", source: str = "source", key: str | None = None,
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, blocks, taken, first_shard,
    and row, which is the column `key` if one is named.

    `taken` counts the words that the mix takes of the document, repetitions included, and
    `first_shard` is the shard of its first taken word (null if none is taken). Null and empty texts
    have no words, null sources are one source, null ids and repeated rows lie in the order like
    others, an empty table gives none; other columns are not read.

    The running sum within a source goes by slabs of the seeded order, 4096 for each source, so a
    source of any size is many tasks. One task handles the list of sources, a few numbers for each.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = stage(docs.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"),
        (F.lit(None) if key is None else F.col(key)).cast("long").alias("row"),
    ).withColumn("_rank", F.md5(F.concat_ws(
        ":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size",
    ))).withColumn("_slab", F.substring("_rank", 1, 3)).withColumn(
        "_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))))

    slabs = stage(rows.groupBy("_key", "source", "_slab").agg(F.sum("size").alias("_words")))
    before = Window.partitionBy("_key").orderBy("_slab").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = slabs.select(
        "_key", "_slab", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))

    def planned(batches):
        # pandas writes a missing text as NaN or None, depending on the column's type
        batches = list(batches)
        if not batches:
            return
        sources = pd.concat(batches, ignore_index=True)
        sources["source"] = [s if isinstance(s, str) else None for s in sources["source"]]
        yield plan(sources, block_words, repeats, shards)

    sources = slabs.groupBy("_key", "source").agg(F.sum("_words").alias("source_size"))
    wanted = stage(sources.coalesce(1).mapInPandas(
        planned,
        "_key string, source string, source_size long, target double, blocks long, "
        "quotas array<long>",
    )).drop("source")
    slab_start = stage(offsets.join(wanted, "_key"))

    so_far = Window.partitionBy("_key", "_slab").orderBy("_rank", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = rows.withColumn(
        "_start", F.coalesce(F.sum("size").over(so_far), F.lit(0))
    ).join(slab_start, ["_key", "_slab"]).withColumn(
        "_start", F.col("_start") + F.col("_offset"))
    limit = F.least(F.col("blocks") * block_words, F.col("source_size") * repeats)
    taken = sum(
        (F.greatest(F.lit(0), F.least(
            F.col("size"), limit - F.col("source_size") * k - F.col("_start")))
         for k in range(repeats)), F.lit(0))
    block = F.floor(F.col("_start") / block_words)
    return placed.select(
        *([] if key is None else ["row"]), "doc_id", "source", "size", "source_size", "target", "blocks",
        taken.cast("long").alias("taken"),
        F.when(taken > 0, F.size(F.filter("quotas", lambda q: q <= block))).cast("int").alias(
            "first_shard"),
    )


def mixed_rows(
    docs: DataFrame, seed: int = 0, id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it.

    What is taken of a row is rounded to whole ones, so that only the first and last row of a source
    in the mix differ from the words taken. Rows without words have no part in the targets and
    stay once. Each row has its own share, whatever ids and texts others have; columns may have any
    name and type.
    """
    # one column holds those of a row, so none of their names meets one of these
    rows = stage(docs.select(
        F.struct(*docs.columns).alias("doc"), F.col(id).alias("doc_id"), F.col(text).alias("text"),
        F.col(source).alias("source"), F.monotonically_increasing_id().alias("row")))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    taken = mix(rows, seed=seed, key="row").select("row", times.alias("times")).where("times > 0")
    return rows.select("row", "doc").join(taken, "row").withColumn(
        "copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc.*")
