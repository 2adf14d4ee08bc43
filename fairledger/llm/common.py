"""Helpers of the operators: texts out of Arrow batches, word hashes, filters by a set of ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a written table that may be broadcast, of 16 to 24 bytes each; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch that are turned into Python objects at once.
SLICE = 4 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers in which each bit depends on all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of `width` words, sorted.

    With fewer words the whole sequence counts as one; without words there is none.
    """
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        out = np.array([len(h)], np.uint64)
        for x in h:
            out = mix(out * _MULTIPLIER + x)
        return out
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix(out * _MULTIPLIER + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `SLICE` bytes, so that Python holds few texts at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def in_arrow(
    df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
) -> DataFrame:
    """`mapInArrow` for a function of one batch, which is called for slices of `SLICE` bytes."""
    def run(batches):
        for batch in slices(batches):
            yield from make(batch)

    return df.mapInArrow(run, schema)


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of `df` whose `on` is in the written table `ids`.

    Up to `BROADCAST_ROWS` ids go to the rows; beyond that both sides are shuffled.
    """
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids.select(on), on, "left_semi")
