"""Exact duplicates, owned by the terminal nodes of Patricia tries.

Texts are equal when they agree after lower-casing A-Z. Partitions by length and content hash hold
tries into which whole byte strings are inserted; the terminal node of a text keeps the smallest
rank that reached it and how many did. The rank is the id, or its negative where the largest id is
to stay. Each input partition builds a trie of its own first, so that a text travels once for each
partition however many copies there are.

A trie has a budget of bytes. Beyond it the heaviest subtree leaves: its texts, and all later ones
under its prefix, go to a written table, and another round with four times the partitions takes
them. As a text lies under one prefix only, no text is in both. A single text may exceed the budget.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.llm.common import texts
from fairledger.plans.staging import stage

TRIE_BYTES = 128 << 20
#: What a node costs besides its label.
NODE_BYTES = 300
OUT_ROWS = 2000

_OWNERS = "length long, hash long, body binary, sha string, rank long, copies long, spilled boolean"


class Node:
    __slots__ = ("label", "children", "rank", "copies", "weight", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.spilled = label, {}, False
        self.rank, self.copies, self.weight = None, 0, len(label) + NODE_BYTES


class Patricia:
    """A compressed radix trie over byte strings, which gives up subtrees beyond `budget` bytes."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.budget, self.held = Node(b""), budget, 0

    def insert(self, text: bytes, rank: int | None, copies: int) -> bool:
        """Count a text at its terminal node; False if its subtree was given up."""
        node, at, path = self.root, 0, [self.root]
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = Node(text[at:])
                node.children[text[at]] = child
                self._weigh(path, child.weight)
            elif not text.startswith(child.label, at):
                child = self._split(node, child, _common(child.label, text, at), path)
            if child.spilled:
                return False
            node, at = child, at + len(child.label)
            path.append(node)
        if rank is not None:
            node.rank = rank if node.rank is None else min(node.rank, rank)
        self.held += not node.copies
        node.copies += copies
        return True

    def _split(self, parent: Node, child: Node, length: int, path: list[Node]) -> Node:
        upper = Node(child.label[:length])
        if child.spilled:  # what is below the split is unknown, so all of it counts as given up
            upper.spilled, upper.weight = True, child.weight
            parent.children[upper.label[0]] = upper
            return upper
        child.label = child.label[length:]
        upper.children[child.label[0]] = child
        parent.children[upper.label[0]] = upper
        upper.weight = child.weight + NODE_BYTES
        child.weight -= length
        self._weigh(path, NODE_BYTES)
        return upper

    @staticmethod
    def _weigh(path: list[Node], more: int) -> None:
        for node in path:
            node.weight += more

    def full(self) -> bool:
        return self.root.weight > self.budget and self.held > 1

    def spill(self):
        """Give up the heaviest subtree that is not all of the trie, and yield its texts."""
        path, node, prefix = [], self.root, b""
        while True:
            open_ = [c for c in node.children.values() if not c.spilled]
            if not open_:
                break
            path.append(node)
            prefix += node.label
            node = max(open_, key=lambda c: c.weight)
            if 2 * node.weight <= self.root.weight:
                break
        for found in self._below(node, prefix):
            self.held -= 1
            yield found
        self._weigh(path, NODE_BYTES - node.weight)
        node.children, node.copies, node.spilled, node.weight = {}, 0, True, NODE_BYTES

    @staticmethod
    def _below(node: Node, prefix: bytes):
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            text = prefix + node.label
            if node.copies:
                yield text, node.rank, node.copies
            todo += [(c, text) for c in node.children.values() if not c.spilled]

    def owners(self):
        """(text, smallest rank, copies) of every terminal node."""
        yield from self._below(self.root, b"")


def _common(label: bytes, text: bytes, at: int) -> int:
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == text[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rows(found, spilled: bool, whole: bool):
    """Batches of owners; texts go along only where they are still to be compared."""
    out, size = [], 0
    for text, rank, copies in found:
        keep = whole or spilled
        out.append((
            len(text), _signed(xxhash.xxh64_intdigest(text)), text if keep else None,
            None if keep else hashlib.sha256(text).hexdigest(), rank, copies, spilled,
        ))
        size += len(text)
        if len(out) >= OUT_ROWS or size > 16 << 20:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in _OWNERS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _first_tries(sign: int, budget: int):
    """The trie of an input partition; when it is full, all it holds goes on and it starts anew."""
    def run(batches):
        trie = Patricia(budget)
        for batch in batches:
            for body, id in zip(texts(batch["text"]), batch["doc_id"].to_pylist()):
                trie.insert(body.lower(), None if id is None else sign * id, 1)
                if trie.root.weight > budget:
                    yield from _rows(trie.owners(), False, True)
                    trie = Patricia(budget)
        yield from _rows(trie.owners(), False, True)

    return run


def _tries(budget: int):
    """The trie of a partition by length and hash; what it has no room for leaves with its text."""
    def run(batches):
        trie = Patricia(budget)
        for batch in batches:
            for body, rank, copies in zip(
                batch["body"].to_pylist(), batch["rank"].to_pylist(), batch["copies"].to_pylist()
            ):
                if not trie.insert(body, rank, copies):
                    yield from _rows([(body, rank, copies)], True, True)
                while trie.full():
                    yield from _rows(trie.spill(), True, True)
        yield from _rows(trie.owners(), False, False)

    return run


def owners(docs: DataFrame, sign: int, budget: int = TRIE_BYTES) -> DataFrame:
    """sha, rank and copies of each distinct text of doc_id, text."""
    spark = docs.sparkSession
    waiting = docs.mapInArrow(_first_tries(sign, budget), _OWNERS)
    partitions, done = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    while True:
        found = stage(
            waiting.repartition(partitions, "length", "hash").mapInArrow(_tries(budget), _OWNERS))
        final = found.where("not spilled").select("sha", "rank", "copies")
        done = final if done is None else done.unionByName(final)
        waiting = found.where("spilled")
        if waiting.isEmpty():
            return done
        partitions *= 4


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id: str = "doc_id", text: str = "text",
    budget: int = TRIE_BYTES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, empty texts are one group. A row without id never stays while another
    has one; in a group without any id keep_id is null and nothing is kept. Rows that repeat an id
    with the same text count each, and are kept or not together. An empty table gives none; other
    columns are not read. Ids are whole numbers; `keep` is "smallest" or "largest".
    """
    sign = {"smallest": 1, "largest": -1}[keep]
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    best = stage(owners(rows, sign, budget))

    def digests(batches):
        for batch in batches:
            sha = [hashlib.sha256(t.lower()).hexdigest() for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(sha, pa.string())], names=["doc_id", "sha"])

    member = rows.mapInArrow(digests, "doc_id long, sha string")
    return member.join(best, "sha").select(
        "doc_id",
        (F.col("rank") * sign).alias("keep_id"),
        F.col("copies").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("rank") * sign, F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
