"""Phrases whose words occur together more often than apart, from FM-indexes of shards.

**Index.** The documents of an input partition are dealt into shards of some million words. A shard
has an index for each language: the Burrows-Wheeler transform over word ids (bytes are never indexed),
pieces being parted by the id 0, and the same of the reversed sequence. Rows are in order of their
first `depth` ids only, which is all that patterns of that length need.

**Enumeration.** A phrase is a pair of intervals of equal length, one in each index. Extending all
phrases of one length to the left by all words that precede them is one pass over the rows of their
intervals: the words before an interval are its stretch of the transform, the last-to-first step of
the first row with a word is where its new interval begins, and the number of smaller words in the
stretch moves the other interval. Single words are extended to the left, longer phrases to the
right, up to `depth`. Counts of phrases are summed over shards by Spark.

**Pruning.** A phrase is as rare as its rarest pair of words. A first pass sums the pairs of all
shards by a 64-bit hash and sets the bits of those that occur `least` times in a filter of fixed
size; only phrases all of whose pairs pass are extended and sent. A pair that passes by chance costs
a row and changes nothing, as the sums of what is sent are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairledger.llm.common import mix, slices, texts
from fairledger.plans.staging import stage

LEAST = 10
LONGEST = 3
TOP = 2000
#: Share in percent of a phrase's occurrences inside one longer phrase from which it is dropped.
INSIDE = 50
#: Words of an input partition that are indexed together.
SHARD_WORDS = 2_000_000
#: The filter of pairs has two to this many bits.
FILTER_BITS = 26
#: Language of rows that name none.
NO_LANG = "und"

_PIECES = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz..........")
_OUT = 65_536
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with a full stop between pieces and at the end."""
    found = text.translate(_PIECES).replace(b".", b" . ").split()
    found.append(b".")
    return found


class _Ids(dict):
    """Numbers words as they come; 0 parts pieces."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the `depth` ids that begin there."""
    size = int(ids.max(initial=0)) + 1
    if size**depth >= 2**63:
        return np.lexsort([np.append(ids[k:], np.zeros(min(k, len(ids)), ids.dtype)) for k in range(depth)][::-1])
    key = ids.astype(np.int64)
    for k in range(1, depth):
        key *= size
        key[: len(ids) - k] += ids[k:]
    return np.argsort(key, kind="stable")


class Index:
    """The transform `before` of a sequence that begins and ends with 0, and its steps `last_first`."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.before = ids[_order(ids, depth) - 1]
        rows = np.argsort(self.before, kind="stable").astype(np.int32)
        self.last_first = np.empty(len(rows), np.int32)
        self.last_first[rows] = np.arange(len(rows), dtype=np.int32)

    def extend(self, low: np.ndarray, n: np.ndarray):
        """All words before each interval [low, low + n): owner, word, low and n of the extended
        phrase here, and by how much its interval in the other index begins later."""
        starts = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        rows = np.arange(len(owner), dtype=np.int32) + np.repeat((low - starts).astype(np.int32), n)
        word = self.before[rows]
        key = owner.astype(np.int64) * (int(self.before.max(initial=0)) + 1) + word
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.arange(0)
        count = np.diff(np.append(at, len(key)))
        first = order[at]
        owner, word, low = owner[first], word[first], self.last_first[rows[first]]
        real = word != 0
        return owner[real], word[real], low[real], count[real], (at - starts[owner])[real]


def phrases(ids: np.ndarray, depth: int, keep):
    """(words, counts) of the phrases of one to `depth` words; words has a column for each place.

    `ids` begins and ends with 0. Of the phrases of two and more words, `keep(a, b)` says whether the
    pairs of adjacent words may be in one; all others are neither extended nor returned.
    """
    forward, backward = Index(ids, depth), Index(ids[::-1], depth)
    n = np.bincount(ids)
    low = np.cumsum(n) - n
    word = np.flatnonzero(n)
    word = word[word != 0]
    words, n, low, other = word[:, None], n[word], low[word], low[word]
    yield words, n
    for size in range(2, depth + 1):
        if size == 2:
            owner, word, low, n, later = forward.extend(low, n)
            words, other = np.column_stack([word, words[owner]]), other[owner] + later
            pair = words
        else:
            owner, word, other, n, later = backward.extend(other, n)
            words, low = np.column_stack([words[owner], word]), low[owner] + later
            pair = words[:, -2:]
        kept = keep(pair[:, 0], pair[:, 1])
        words, n, low, other = words[kept], n[kept], low[kept], other[kept]
        yield words, n


def _shards(batches, shard_words: int):
    """(ids by word, {language: sequences of ids}) of each shard of an input partition."""
    ids, found, words = _Ids(), {}, 0
    for batch in slices(batches):
        for lang, text in zip(batch["lang"].to_pylist(), texts(batch["text"])):
            parts = tokens(text)
            found.setdefault(lang, []).append(
                np.fromiter(map(ids.__getitem__, parts), np.int32, len(parts)))
            words += len(parts)
            if words >= shard_words:
                yield ids, found
                ids, found, words = _Ids(), {}, 0
    if words:
        yield ids, found


def _hashes(ids: _Ids) -> np.ndarray:
    """The hash of each word by its id."""
    return np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))


def _pair_hash(lang: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    seed = np.uint64(xxhash.xxh64_intdigest(lang))
    return mix(mix(a + seed) * _FACTOR + b)


def pair_counts(rows: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """hash and n of the adjacent pairs of words of each shard."""
    def make(batches):
        for ids, found in _shards(batches, shard_words):
            of = _hashes(ids)
            for lang, parts in found.items():
                seq = np.concatenate(parts)
                both = (seq[:-1] != 0) & (seq[1:] != 0)
                h, n = np.unique(
                    _pair_hash(lang, of[seq[:-1][both]], of[seq[1:][both]]), return_counts=True)
                for at in range(0, len(h), _OUT):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[at : at + _OUT].view(np.int64)), pa.array(n[at : at + _OUT])],
                        names=["hash", "n"])

    return rows.mapInArrow(make, "hash long, n long")


def pair_filter(counts: DataFrame, least: int) -> np.ndarray:
    """2 ** FILTER_BITS bits, in which those of the pairs that occur `least` times are set.

    What comes to the driver is one number for each 64 bits at most, whatever the data.
    """
    slot = F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    found = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).groupBy(
        F.shiftright(slot, 6).cast("int").alias("place")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrase_counts(
    docs: DataFrame, depth: int = LONGEST, least: int = LEAST, lang: str = "lang", text: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """lang, phrase (words joined by blanks), n: a written table of all phrases of one to `depth`
    words that occur `least` times in a language; an empty phrase counts all words of the language.

    Null texts are empty, null languages `und`. Counts are those of all rows, repeated ones included.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(pair_filter(pair_counts(rows, shard_words), least))

    def make(batches):
        for ids, found in _shards(batches, shard_words):
            of, words = _hashes(ids), pa.array(ids, pa.binary())
            for lang, parts in found.items():
                def keep(a, b):
                    return passes(bits.value, _pair_hash(lang, of[a], of[b]))

                seq = np.concatenate([np.zeros(1, np.int32), *parts])
                parts.clear()
                total = np.count_nonzero(seq)
                if total:
                    yield _out(lang, pa.array([b""], pa.binary()), np.array([total]))
                for found_words, n in phrases(seq, depth, keep):
                    for at in range(0, len(n), _OUT):
                        columns = [words.take(pa.array(c)) for c in found_words[at : at + _OUT].T]
                        yield _out(lang, pc.binary_join_element_wise(*columns, b" "), n[at : at + _OUT])

    sent = rows.mapInArrow(make, "lang string, phrase binary, n long")
    summed = sent.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stage(summed.where((F.col("n") >= least) | (F.length("phrase") == 0)).withColumn(
        "phrase", F.col("phrase").cast("string")))


def _out(lang: str, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang), len(n)), phrase, pa.array(n, pa.int64())],
        names=["lang", "phrase", "n"])


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside: int = INSIDE,
    lang: str = "lang", text: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at blanks and tabs, A-Z
    lower-cased. Candidates have two to `longest` words and a >= `least` occurrences within pieces.
    Cut in two, a candidate's parts occur l and r times; its score floor(1000000 a a / (l r)) is that
    of the lowest-scoring cut, the first of those. A candidate of whose occurrences `inside` percent
    or more lie in one longer candidate is dropped. Ranks go by score and a, largest first, then by
    phrase in byte order. n counts all words of the language.

    Numbers are exact up to 10 ** 16 occurrences of a phrase. Null and empty texts have no words, null
    languages are `und`, as are rows that say so; repeated rows count each time; an empty table and
    languages without candidates give no rows; other columns are not read.
    """
    counts = phrase_counts(docs, longest, least, lang, text, shard_words)
    size = F.size(F.split("phrase", " "))
    found = counts.where((F.col("phrase") != "") & (size > 1)).withColumnRenamed("n", "a")
    cuts = found.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"),
    ).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"),
        F.expr("substring_index(phrase, ' ', k - size(split(phrase, ' ')))").alias("right"))
    parts = counts.where(F.col("phrase") != "")
    both = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(
        parts.toDF("lang", "right", "r"), ["lang", "right"])
    exact = "cast({} as decimal(19, 0))".format
    score = F.expr(f"{exact('a')} * {exact('a')} * 1000000 div ({exact('l')} * {exact('r')})")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = F.split("phrase", " ")
    # what lies in a longer phrase lies in one that is a word longer, and that occurs as often
    longer = counts.where(size > 2).select("lang", "n", F.explode(F.array(
        F.array_join(F.slice(words, 1, size - 1), " "), F.array_join(F.slice(words, 2, size - 1), " "),
    )).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))
    ).select("lang", "phrase", "a", "cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_salts(docs.sparkSession))))
    best = left.withColumn("rank", F.row_number().over(dealt.orderBy(*order))).where(
        F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where(F.col("phrase") == "").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _salts(spark: SparkSession) -> int:
    """Parts of a language that are ranked by themselves first: as many as tasks after a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
