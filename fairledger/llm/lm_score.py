"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

S(w | u v) = c(u v w) / c(u v) where c(u v w) >= `least`, otherwise 0.4 S(w | v); the last step is
c(w) / N. The score of a document is the sum of log S over its words; n-grams do not cross documents.

Documents are dealt into blocks by hash, of about `BLOCK_BYTES` of text each. A block sends its distinct
n-grams, with its own counts, to the partitions of the count table, which are ranges of n-gram hashes. There the counts of all blocks are
summed, and each block gets the totals of what it asked for. So the exploded n-grams travel once, as
question and contribution at the same time, a frequent n-gram travels once for each block, and the
answers are bare counts in the order of the question. Sorted hashes travel as gaps, counts mostly as bits. Words and pairs go first; a longer n-gram
can only reach `least` if both n-grams it begins and ends with do, so only such ones are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.llm.common import mix, texts
from fairledger.plans.staging import stage

ORDER, LEAST, BACKOFF = 3, 2, 0.4
#: Text of a block, and how many blocks texts of a MB each and more are dealt into at least.
BLOCK_BYTES, FEWEST = 14 << 20, 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ASKED = "block int, level int, part int, grams binary, counts binary"
_TOLD = "block int, level int, part int, totals binary"


def pack(keys: np.ndarray, parts: int) -> bytes:
    """Sorted hashes of one partition, as the gaps of their quotients by the number of partitions."""
    gaps = np.diff(keys // np.uint64(parts), prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, part: int, parts: int) -> np.ndarray:
    width = data[0]
    gaps = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    quotients = np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)
    return quotients * np.uint64(parts) + np.uint64(part)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of one or more: a bit for those above one, a byte for each of these, large ones whole."""
    more = counts[counts > 1]
    return b"".join([
        len(counts).to_bytes(8, "big"), np.packbits(counts > 1).tobytes(),
        np.minimum(more, 255).astype(np.uint8).tobytes(), more[more >= 255].tobytes()])


def unpack_counts(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "big")
    at = 8 + -(-size // 8)
    above = np.unpackbits(np.frombuffer(data[8:at], np.uint8), count=size).astype(bool)
    more = np.frombuffer(data, np.uint8, int(above.sum()), at).astype(np.int64)
    more[more == 255] = np.frombuffer(data[at + len(more) :], np.int64)
    out = np.ones(size, np.int64)
    out[above] = more
    return out


def lows(parts: int) -> np.ndarray:
    """The smallest hash of each partition of the count table."""
    return np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)


class Block:
    """The n-grams of some documents, as hashes by the position of their last word."""

    def __init__(self, bodies: list[bytes]):
        known, hashes = {}, [np.empty(0, np.uint64)]
        for body in bodies:  # the words of one text at a time are held as objects
            words = body.lower().split()
            known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
            hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        self.lengths = np.array([len(h) for h in hashes[1:]], np.int64)
        self.words = np.concatenate(hashes)
        starts = np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.place = np.arange(len(self.words)) - starts
        self.grams = {1: mix(self.words + np.uint64(1))}
        #: Corpus counts of the n-grams that end at each place; 0 where none was asked for.
        self.counts = {}

    def gram(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n-grams, and where there is one."""
        if n not in self.grams:
            shorter = self.gram(n - 1)[0]
            out = np.zeros(len(self.words), np.uint64)
            out[1:] = mix(shorter[:-1] * _MULTIPLIER + self.words[1:] + np.uint64(n))
            self.grams[n] = out
        return self.grams[n], self.place >= n - 1

    def wanted(self, level: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a level that are asked for, and the places of its longest ones.

        Level 1 has a word for each place and then pairs, level k n-grams of k + 1 words.
        """
        grams, there = self.gram(level + 1)
        if level == 1:
            return np.concatenate([self.grams[1], grams[there]]), there
        often = self.counts.get(level, np.zeros(len(self.words), np.int64)) >= least
        there = there & often
        there[1:] &= often[:-1]
        return grams[there], there

    def ask(self, level: int, least: int, parts: int):
        """Distinct n-grams in order, their counts here, and the bounds of partitions."""
        keys, counts = np.unique(self.wanted(level, least)[0], return_counts=True)
        return keys, counts, np.append(np.searchsorted(keys, lows(parts)), len(keys))

    def hear(self, level: int, least: int, answers: dict[int, bytes]) -> None:
        """Takes the totals of the n-grams that `ask` gives, in their order."""
        grams, there = self.wanted(level, least)
        order, start = _runs(grams)
        totals = np.concatenate([unpack_counts(answers[p]) for p in sorted(answers)])
        each = np.empty(len(grams), np.int64)
        each[order] = np.repeat(totals, np.diff(np.append(start, len(grams))))
        size = len(self.words)
        if level == 1:
            self.counts[1], each = each[:size], each[size:]
        self.counts[level + 1] = np.zeros(size, np.int64)
        self.counts[level + 1][there] = each


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each distinct key begins."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _asked(block: int, level: int, asked, parts: int) -> pa.Table:
    keys, counts, ends = asked
    some, low = np.flatnonzero(np.diff(ends)), lows(parts)
    return pa.table({
        "block": pa.array(np.full(len(some), block, np.int32)),
        "level": pa.array(np.full(len(some), level, np.int32)),
        "part": pa.array(some.astype(np.int32)),
        "grams": pa.array([pack(keys[ends[p] : ends[p + 1]] - low[p], 1) for p in some], pa.binary()),
        "counts": pa.array(
            [pack_counts(counts[ends[p] : ends[p + 1]]) for p in some], pa.binary()),
    })


def _total(table: pa.Table) -> pa.Table:
    """Adds up the counts of a partition of the count table, and answers each question."""
    asked = [unpack(g, 0, 1) for g in table["grams"].to_pylist()]
    counts = np.concatenate([unpack_counts(c) for c in table["counts"].to_pylist()])
    order, start = _runs(np.concatenate(asked))
    totals = np.empty(len(counts), np.int64)
    totals[order] = np.repeat(
        np.add.reduceat(counts[order], start), np.diff(np.append(start, len(counts))))
    answers = np.split(totals, np.cumsum([len(a) for a in asked])[:-1])
    return table.select(["block", "level", "part"]).append_column(
        "totals", pa.array([pack_counts(a) for a in answers], pa.binary()))


def _heard(docs: pa.Table, told: pa.Table, least: int) -> Block:
    block = Block(texts(docs["text"].combine_chunks()))
    answers = {}
    for level, part, totals in zip(
        told["level"].to_pylist(), told["part"].to_pylist(), told["totals"].to_pylist()
    ):
        answers.setdefault(level, {})[part] = totals
    for level in sorted(answers):
        block.hear(level, least, answers[level])
    return block


def parts_of(rows: DataFrame) -> int:
    """Number of blocks of the texts, by their bytes alone.

    Each block has a question for each partition, of 2 KB and more up to 50 GB of text.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // BLOCK_BYTES), min(FEWEST, size >> 20))


def backoff_scores(
    docs: DataFrame, order: int = ORDER, least: int = LEAST, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, hits_1 .. hits_order, log_score, per_word.

    Words are runs without white space, A-Z lower-cased; hits_n counts the words scored by n-grams
    of n words. Null and empty texts have no words, log_score 0 and per_word null; null ids and
    repeated rows count and are scored like others, an empty table gives none; other columns are not
    read. `order` is 2 at least. There are as many partitions of the counts as blocks, and their number
    goes by the bytes of all texts, which bounds the memory of a task.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = parts_of(rows)
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))

    def first(table: pa.Table) -> pa.Table:
        block = Block(texts(table["text"].combine_chunks()))
        return _asked(table["block"][0].as_py(), 1, block.ask(1, least, parts), parts)

    def further(level):
        def ask(docs: pa.Table, told: pa.Table) -> pa.Table:
            if not len(told):  # no words
                return _asked(0, level, (np.empty(0, np.uint64), np.empty(0), np.zeros(parts + 1)), parts)
            block = _heard(docs, told, least)
            return _asked(docs["block"][0].as_py(), level, block.ask(level, least, parts), parts)

        return ask

    def scored(docs: pa.Table, told: pa.Table) -> pa.Table:
        block = _heard(docs, told, least)
        size = len(block.words)
        value, hit = np.zeros(size), np.zeros(size, np.int64)
        if size:
            count = block.counts
            longest = np.minimum(block.place + 1, order)
            value, hit = np.log(count[1]), np.ones(size, np.int64)
            for n in range(2, order + 1):
                if n not in count:
                    break
                often = (count[n] >= least) & (block.place >= n - 1)
                context = np.concatenate([[1], count[n - 1][:-1]])
                value[often] = np.log(count[n][often]) - np.log(context[often])
                hit[often] = n
            value += (longest - hit) * np.log(BACKOFF)
        owner = np.repeat(np.arange(len(block.lengths)), block.lengths)
        each = lambda x: np.bincount(owner, x, len(block.lengths))
        return pa.table({
            "doc_id": docs["doc_id"].combine_chunks(), "n_words": pa.array(block.lengths),
            **{f"hits_{n}": pa.array(each(hit == n).astype(np.int64)) for n in range(1, order + 1)},
            "sum": pa.array(each(value).astype(float)),
        })

    told = blocks.groupBy("block").applyInArrow(first, _ASKED).groupBy("part").applyInArrow(
        _total, _TOLD)
    for level in range(2, order):
        asked = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
            further(level), _ASKED)
        told = told.unionByName(asked.groupBy("part").applyInArrow(_total, _TOLD))
    hits = ", ".join(f"hits_{n} long" for n in range(1, order + 1))
    done = stage(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        scored, f"doc_id long, n_words long, {hits}, sum double"))
    size = done.agg(F.sum("n_words")).first()[0] or 1
    value = F.col("sum") - F.col("hits_1") * F.log(F.lit(float(size)))
    return done.select(
        "doc_id", "n_words", *(f"hits_{n}" for n in range(1, order + 1)),
        value.alias("log_score"),
        F.when(F.col("n_words") > 0, value / F.col("n_words")).alias("per_word"),
    )
