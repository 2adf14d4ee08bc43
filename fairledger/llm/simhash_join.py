"""Near copies by SimHash: fingerprints of word shingles, linked at a few differing bits, exactly.

**Embedding.** A fingerprint is cut into segments of two bits, and a segment is mapped to its number
of ones. A flipped bit changes one of these counts by one, so the Manhattan distance of two vectors
of counts is a lower bound of the number of differing bits. Counts are written in unary, which for
two bits means that each segment has its bits in order; the Manhattan distance is then the number
of ones in the exclusive or of two codes.

**Grid.** The coordinates are dealt into blocks. Vectors within a distance of `bits` agree in all but
`bits` of the blocks at most, so they share a cell of width one in one of the grids over all blocks
but `bits`. How many blocks there are is chosen by cost: more of them make more rows, fewer of them
make fuller cells. Only cells with several fingerprints are kept. In a cell pairs are joined under
the bound on Manhattan distance and verified on all bits.

**Full cells.** Thousands of near copies have fingerprints of their own in one cell. Fingerprints of
cells with more than `FULL` of them go on to a finer grid, whose segments are single bits; the last
one fixes all but a quarter of the bits, so its cells have a size bound whatever the data.

Equal fingerprints are one node, counted before anything is shuffled by key.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairledger.llm.common import in_arrow, keep_ids, texts
from fairledger.llm.components import components, thinned
from fairledger.plans.staging import stage

SEED = 42
#: Fingerprints in a cell up to which its pairs are joined.
FULL = 1024
#: Blocks of the finer grids over single bits.
FINER = (8, 12, 16)
#: Cost of a pair in a cell, in rows of a grid.
PAIR_COST = 0.25
#: Shingles whose bits are counted at once.
CHUNK = 32_768

_LOW = 0x5555555555555555


def fingerprint(text: bytes, width: int = 4, seed: int = SEED) -> int:
    """The majority of each bit over the XXH64 of all shingles, repeats included.

    Fewer than `width` words are one shingle, no words give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    body, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        cut = zip(starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist())
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(body[a:b], seed) for a, b in cut), np.uint64, upto - at)
        ones += np.unpackbits(
            hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, width: int = 4, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and fingerprint (64 bits as a signed long) of each row."""
    def make(batch):
        found = np.array([fingerprint(t, width) for t in texts(batch["text"])], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_arrow(rows, "doc_id long, fingerprint long", make)


def embedding(x: Column) -> Column:
    """The counts of ones of all segments of two bits, in unary."""
    pair = F.shiftrightunsigned(x, 1)
    return x.bitwiseOR(pair).bitwiseAND(F.lit(_LOW)).bitwiseOR(
        F.shiftleft(x.bitwiseAND(pair).bitwiseAND(F.lit(_LOW)), 1))


def masks(blocks: int, bits: int, segment: int) -> list[int]:
    """For each choice of all blocks but `bits`, the bits of their segments, as signed longs."""
    count = 64 // segment
    cuts = [k * count // blocks * segment for k in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    found = (sum(chosen) for chosen in combinations(parts, blocks - bits))
    return [m - (1 << 64) if m >> 63 else m for m in found]


def holes(mask: int, blocks: int, bits: int, segment: int) -> list[int]:
    """The blocks left out below the last one of a choice, filled up with zeros.

    Of the grids in which two codes share a cell, the first is the one whose holes all differ.
    """
    parts = masks(blocks, blocks - 1, segment)
    inside = [k for k, p in enumerate(parts) if mask & p == p]
    found = [parts[k] for k in range(inside[-1]) if k not in inside]
    return found + [0] * (bits - len(found))


def blocks_by_cost(count: int, bits: int) -> int:
    """The number of blocks whose rows and pairs in cells cost least for `count` fingerprints.

    A count of ones in two random bits tells one and a half bits.
    """
    def cost(blocks: int) -> float:
        cells = 2.0 ** (1.5 * 32 * (blocks - bits) / blocks)
        return comb(blocks, bits) * (1 + PAIR_COST * count / cells / 2)

    return min(range(bits + 1, 17), key=cost)


def _grid(nodes: DataFrame, blocks: int, bits: int, segment: int) -> DataFrame:
    """cell, x, code and grid (a number) of each fingerprint in each grid over all blocks but `bits`."""
    code = embedding(F.col("x")) if segment == 2 else F.col("x")
    return nodes.select(
        "x", code.alias("code"), F.posexplode(F.lit(masks(blocks, bits, segment))).alias("grid", "mask")
    ).select(F.xxhash64("mask", F.col("code").bitwiseAND(F.col("mask"))).alias("cell"), "x", "code", "grid")


def links(nodes: DataFrame, bits: int = 4, full: int = FULL) -> DataFrame:
    """Pairs a < b of the distinct fingerprints `x` that differ in at most `bits` bits; each once.

    A pair is joined in the first of the cells that it shares. `nodes` is read several times.
    """
    found, grids = None, [(blocks_by_cost(nodes.count(), bits), 2), *((b, 1) for b in FINER if b > bits)]
    for k, (blocks, segment) in enumerate(grids):
        last = k == len(grids) - 1
        cells = _grid(nodes, blocks, bits, segment)
        shared = stage(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        some = stage(keep_ids(cells, shared if last else shared.where(F.col("n") <= full), "cell"))
        a, b = some.toDF("cell", "a", "code_a", "grid"), some.toDF("cell", "b", "code_b", "_")
        differ = F.col("code_a").bitwiseXOR(F.col("code_b"))
        near = (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= bits) & (
            F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        if bits:
            lists = [holes(m, blocks, bits, segment) for m in masks(blocks, bits, segment)]
            for place in range(bits):
                hole = F.element_at(F.lit([h[place] for h in lists]), F.col("grid") + 1)
                near &= (hole == 0) | (differ.bitwiseAND(hole) != 0)
        pairs = a.join(b, near).select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        crowded = shared.where(F.col("n") > full)
        if last or crowded.isEmpty():
            return found.distinct()
        nodes = stage(keep_ids(cells, crowded, "cell").select("x").distinct())


def near_duplicates(
    docs: DataFrame, width: int = 4, bits: int = 4, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (signed long), component_id.

    Words are runs without white space, A-Z lower-cased. Texts that are null, empty or without words
    have the fingerprint zero, which is linked like any other. component_id is the smallest doc_id
    reachable by links of at most `bits` differing bits. Rows that repeat an id have the component of
    their own text; null ids are linked but never name a component (it is null if no row has an id);
    an empty table gives none; other columns are not read.
    """
    rows = stage(fingerprints(docs, width, id, text))
    nodes = stage(rows.groupBy(F.col("fingerprint").alias("x")).agg(F.min("doc_id").alias("low")))
    parts = components(thinned(stage(links(nodes.select("x"), bits)))).withColumnRenamed("node", "x")
    known = stage(nodes.join(parts, "x", "left").select(
        "x", "low", F.coalesce("component", "x").alias("part")))
    names = stage(known.groupBy("part").agg(F.min("low").alias("component_id")))
    named = stage(known.join(names, "part").select(F.col("x").alias("fingerprint"), "component_id"))
    return rows.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hexadecimal(fingerprint: Column) -> Column:
    """16 lowercase digits of a signed long."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
