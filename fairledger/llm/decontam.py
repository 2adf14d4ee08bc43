"""Test items inside documents: size-partitioned MinHash containment search, verified exactly.

An item is found in a document that holds at least a share of the item's distinct word n-grams.
Items are partitioned by size. The sketch of an item is its k n-grams of smallest hash; k is one
more than the n-grams which the largest item of its partition may miss, so a document that contains
the item holds one of them at least, and no document is too long for that: the search has no false
negatives. A document that holds enough of a sketch is then compared with the whole item.

Items are compared in blocks of bounded size, each of which goes to all documents; a benchmark of
any size is more blocks, each of them one more pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.llm.common import in_arrow, shingles
from fairledger.plans.staging import stage

#: n-grams of items that are held by the driver and each task at once.
BLOCK_SHINGLES = 2_000_000
SEPARATORS = bytes(range(0x30)) + b":;<=>?@[\\]^_`{|}~\x7f"
_BLANKS = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and anything that is not ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANKS).split()


def sketch_size(n: int, num: int, den: int) -> int:
    """n-grams in the sketch of an item of n, by its size partition: up to 1, 3, 7, 15, ..."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest - -(-largest * num // den) + 1)


def item_shingles(
    items: DataFrame, width: int, id: str = "item_id", text: str = "text",
) -> DataFrame:
    """item_id, width, shingles; an item of fewer words is one n-gram of that width."""
    def make(batch):
        found = [words(t) for t in batch["text"].to_pylist()]
        widths = [min(width, len(w)) for w in found]
        sets = [shingles(w, k).view(np.int64) for w, k in zip(found, widths)]
        yield pa.RecordBatch.from_arrays([
            batch["item_id"], pa.array(widths, pa.int32()), pa.array(sets, pa.list_(pa.int64()))
        ], names=["item_id", "width", "shingles"])

    rows = items.select(F.col(id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return in_arrow(rows, "item_id long, width int, shingles array<long>", make).where("width > 0")


class Block:
    """The sketches and whole n-gram sets of some items."""

    def __init__(self, rows, num: int, den: int):
        self.ids = [r.item_id for r in rows]
        self.sets = [np.array(r.shingles, np.int64).view(np.uint64) for r in rows]
        self.need = [-(-len(s) * num // den) for s in self.sets]
        self.widths = sorted({r.width for r in rows})
        self.keys, self.owners, self.enough = {}, {}, np.empty(len(rows), np.int64)
        for width in self.widths:
            keys, owners = [], []
            for i, r in enumerate(rows):
                if r.width == width:
                    k = sketch_size(len(self.sets[i]), num, den)
                    keys.append(self.sets[i][:k])  # sorted by hash
                    owners.append(np.full(k, i))
                    self.enough[i] = max(1, k - (len(self.sets[i]) - self.need[i]))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            self.keys[width], self.owners[width] = keys[order], owners[order]

    def found(self, text: list[bytes]):
        """(item, n-grams of the item, of these in the text) of the items the text contains."""
        for width in self.widths:
            if len(text) < width:
                continue
            own, keys = shingles(text, width), self.keys[width]
            low = np.searchsorted(keys, own, "left")
            hit = low < len(keys)
            hit[hit] = keys[low[hit]] == own[hit]
            if not hit.any():
                continue
            low = low[hit]
            high = np.searchsorted(keys, own[hit], "right")
            hits = np.concatenate([self.owners[width][a:b] for a, b in zip(low, high)])
            items, count = np.unique(hits, return_counts=True)
            for i in items[count >= self.enough[items]]:
                n = int(np.isin(self.sets[i], own, assume_unique=True).sum())
                if n >= self.need[i]:
                    yield self.ids[i], len(self.sets[i]), n


def _blocks(
    items: DataFrame, width: int, containment: tuple[int, int], id: str, text: str,
    block_shingles: int,
):
    """Broadcasts of the blocks of items."""
    sized = stage(item_shingles(items, width, id, text).withColumn(
        "_size", F.size("shingles").cast("long")))
    total = sized.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (block_shingles // 2)))
    for b in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == b)
        block = mine.collect()  # about half of block_shingles
        if block:
            yield items.sparkSession.sparkContext.broadcast(Block(block, *containment))


def contained(
    docs: DataFrame, items: DataFrame, width: int = 5, containment: tuple[int, int] = (4, 5),
    id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """doc_id, item_id, item_shingles, found, containment of every item in a document.

    `containment` is a fraction. An item of fewer than `width` words is one n-gram as a whole; items
    that are null, empty or without words are in no document, such documents contain no item. Null
    ids are returned as null, repeated rows of either side give repeated rows, an empty table gives
    none; other columns are not read.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for held in _blocks(items, width, containment, item_id, item_text, block_shingles):
        def make(batch, held=held):
            got = [
                (doc, *f) for doc, body in zip(
                    batch["doc_id"].to_pylist(), batch["text"].to_pylist())
                for f in held.value.found(words(body))
            ]
            columns = zip(*got) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "item_id", "item_shingles", "found"])

        part = in_arrow(rows, "doc_id long, item_id long, item_shingles long, found long", make)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).select(
            "doc_id", *(F.lit(0).cast("long").alias(c) for c in ("item_id", "item_shingles", "found")))
    return out.withColumn("containment", F.col("found") / F.col("item_shingles"))


def without_items(
    docs: DataFrame, items: DataFrame, width: int = 5, containment: tuple[int, int] = (4, 5),
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The rows of `docs` whose own text contains no item, as `contained` finds them."""
    at = docs.columns.index(text)
    for held in _blocks(items, width, containment, item_id, item_text, block_shingles):
        def clean(batch, held=held):
            yield batch.filter(pa.array([
                next(held.value.found(words(body)), None) is None
                for body in batch.column(at).to_pylist()], pa.bool_()))

        docs = in_arrow(docs, docs.schema, clean)
    return docs
