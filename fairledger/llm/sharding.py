"""Reproducible shuffle of all rows into shards, by a Feistel permutation of global row numbers.

Row numbers 0 .. n-1 follow from the rows alone. A balanced Feistel network permutes the smallest
domain of 4^h that holds them; a number that falls outside 0 .. n-1 is sent through again until it
is inside (cycle walking), which leaves a permutation of 0 .. n-1. Position p then lies in shard
p mod k at slot p div k, so shards differ by one row at most, and both ways can be computed without
the table: `position` from a row number, `row_number` from a shard and slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairledger.plans.staging import stage

ROUNDS = 6
BUCKETS = 4096


def _keys(seed: int) -> list[np.uint64]:
    return [
        np.uint64(int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:8], "big"))
        for r in range(ROUNDS)
    ]


def _round(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = (half ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) & mask


def _walk(numbers, size: int, seed: int, forward: bool) -> np.ndarray:
    out = np.array(numbers, np.uint64)
    if size < 2:
        return out.astype(np.int64)
    bits = np.uint64(((size - 1).bit_length() + 1) // 2)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    keys = _keys(seed)

    def once(x):
        left, right = x >> bits, x & mask
        for key in keys if forward else reversed(keys):
            if forward:
                left, right = right, left ^ _round(right, key, mask)
            else:
                left, right = right ^ _round(left, key, mask), left
        return (left << bits) | right

    out = once(out)
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def position(row_numbers, size: int, seed: int = 0) -> np.ndarray:
    """Where the shuffle puts these row numbers of a table of `size` rows."""
    return _walk(row_numbers, size, seed, True)


def row_number(positions, size: int, seed: int = 0) -> np.ndarray:
    """The row numbers that the shuffle puts at these positions."""
    return _walk(positions, size, seed, False)


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Numbers 0 .. n-1 that depend on the values of `order` only; `rows` is a written table.

    Rows are put in hash buckets, numbered by `order` within each, and shifted by the buckets
    before. There are always `BUCKETS` counts to broadcast. Rows alike in all of `order` may swap.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(*order)
    return (
        rows.join(F.broadcast(offsets), "_bucket")
        .withColumn(out, F.row_number().over(within) - 1 + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def shard(
    docs: DataFrame, shards: int = 16, seed: int = 0, id: str = "doc_id", text: str = "text",
    whole: bool = False,
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, row_number, shard, slot.

    `whole` adds the other columns of `docs`, which is then a written table; of two columns of one
    name the one listed here counts.

    Row numbers follow id, size and checksum. Null texts have size 1 and the checksum of no bytes,
    null ids are numbered like others, repeated rows get different slots, an empty table gives
    none, other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        *([F.struct(*docs.columns).alias("doc")] if whole else []),
    )
    rows = rows if whole else stage(rows)
    n = rows.count()

    @F.pandas_udf("long")
    def shuffled(numbers: pd.Series) -> pd.Series:
        return pd.Series(position(numbers.to_numpy(), n, seed))

    placed = numbered(rows, ["doc_id", "size", "text_crc32"], "row_number").withColumn(
        "_p", shuffled("row_number"))
    own = ["doc_id", "size", "text_crc32", "row_number", "shard", "slot"]
    return placed.withColumn("shard", F.pmod("_p", F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("_p") / shards).cast("long")
    ).select(*own, *[F.col("doc").getField(c).alias(c) for c in docs.columns if whole and c not in own])
