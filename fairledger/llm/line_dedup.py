"""Repeated passages, by hashing normalised lines and the sentences of lines.

A unit is a line, or a sentence of it where a line has several (a sentence ends in . ! or ? before a
blank). Units of `unit_words` words and more are compared by the digest of their normalised form: A-Z
lower-cased, white space runs one blank. Digests are grouped over all rows; the earliest occurrence
owns its digest, all others point to it.

What is repeated is seldom a whole number of units: a passage is pasted into a line, so its first and
last sentence are glued to other text, and it has sentences that are too short to be told apart. A
unit that was met again is therefore only an anchor. From each one the words of the row are compared
with those of its owner, to both sides, as far as they agree. Where `passage_words` or more agree, they
are removed, whatever units they are of. A row and an owner are compared whenever they share a unit;
`shared_words` leaves out those whose shared units have fewer words, with the passages they may share.

Occurrences rank by document id, then text, then place in the text; rows without id come last. What is
removed always has an earlier occurrence, so the first one stays. Offsets are code points of the
original text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.llm.common import BROADCAST_ROWS, in_arrow, keep_ids
from fairledger.plans.staging import stage

UNIT_WORDS = 4
PASSAGE_WORDS = 50
SHARED_WORDS = 12  # a bound of the SQL, not of the operator
_END = re.compile(r"(?<=[.!?])[ \t]+|\n+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def units(text: str):
    """(start, end) of each unit, end included its separator."""
    at = 0
    for m in _END.finditer(text):
        if m.end() > at:
            yield at, m.end()
            at = m.end()
    if at < len(text):
        yield at, len(text)


_UNIT = "doc_id long, hash long, row long, start long, words long, digest binary"


def _unit_rows(unit_words: int):
    def make(batch):
        found = []
        for k, text in enumerate(batch["text"].to_pylist()):
            for start, end in units(text or ""):
                words = text[start:end].encode("utf-8", "replace").lower().split()
                if len(words) >= unit_words:
                    digest = hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
                    found.append((k, start, len(words), digest))
        for at in range(0, max(1, len(found)), 50_000):
            part = found[at : at + 50_000]
            place, start, words, digest = zip(*part) if part else [[]] * 4
            of = batch.select(["doc_id", "hash", "row"]).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*of.columns, pa.array(start, pa.int64()), pa.array(words, pa.int64()),
                 pa.array(digest, pa.binary())], names=[c.split()[0] for c in _UNIT.split(", ")])

    return make


def numbered(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table with a number for each row: doc_id, hash (of the text), row, text.

    `row` tells rows of one id apart. It depends on how the table is read, but decides only between
    rows of one id and one text, any of which may be the first.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stage(rows.select(
        "doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"), "text"))


def agreeing(text: str, owner: str, anchors: list[tuple[int, int]], least: int, same: bool):
    """(start, length, words, start in the owner) of the runs of `least` and more words that agree
    around anchors, which are offsets of equal words in both. `same`: both are one row."""
    lower = [t.encode("utf-8", "replace").lower().decode() for t in (text, owner)]
    spans = [[m.span() for m in _WORD.finditer(t)] for t in lower]
    words = [[t[a:b] for a, b in s] for t, s in zip(lower, spans)]
    starts = [[a for a, _ in s] for s in spans]
    done: dict[int, int] = {}
    for a, b in sorted(anchors):
        i, j = bisect_left(starts[0], a), bisect_left(starts[1], b)
        if i < done.get(i - j, 0) or (same and i <= j):
            continue
        lo = 0
        while lo < min(i, j) and words[0][i - lo - 1] == words[1][j - lo - 1]:
            lo += 1
        hi, most = 0, min(len(words[0]) - i, len(words[1]) - j)
        while hi < most and words[0][i + hi] == words[1][j + hi]:
            hi += 1
        done[i - j] = i + hi
        if lo + hi >= least:
            first, last = starts[0][i - lo], spans[0][i + hi - 1][1]
            yield first, last - first, lo + hi, starts[1][j - lo]


def repeats(
    rows: DataFrame, unit_words: int = UNIT_WORDS, passage_words: int = PASSAGE_WORDS,
    shared_words: int = 0,
) -> DataFrame:
    """Spans to remove from the rows of `numbered`: row, start, length, words, keep_doc_id, keep_start.

    Spans of one row may overlap where it shares words with several owners. Null and empty texts have
    no units. Rows without id may own and are cut like others, and so is a row that repeats an id
    and its text. An empty table gives none.
    """
    found = in_arrow(rows, _UNIT, _unit_rows(unit_words))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "row", "start")
    first = stage(
        found.groupBy("digest").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", F.col("keep.row").alias("keep_row"), F.col("keep.start").alias("keep_start")))
    again = found.join(first, "digest").where("row != keep_row or start != keep_start")
    pairs = stage(
        again.groupBy("row", "keep_row").agg(
            F.sum("words").alias("shared"), F.collect_list(F.struct("start", "keep_start")).alias("anchors"))
        .where(F.col("shared") >= shared_words).drop("shared"))
    owners = rows.select(
        F.col("row").alias("keep_row"), F.col("doc_id").alias("keep_doc_id"), F.col("text").alias("owner"))
    # only texts that are compared are shuffled
    texts = keep_ids(rows.select("row", "text"), pairs.select("row").distinct(), "row")
    owners = keep_ids(owners, pairs.select("keep_row").distinct(), "keep_row")
    both = pairs.join(texts, "row").join(owners, "keep_row")

    def make(batch):
        out = []
        for row, keep_row, anchors, text, keep_doc, owner in zip(
                *(batch[c].to_pylist() for c in ("row", "keep_row", "anchors", "text", "keep_doc_id", "owner"))):
            places = [(a["start"], a["keep_start"]) for a in anchors]
            for start, length, words, keep in agreeing(text, owner, places, passage_words, row == keep_row):
                out.append((row, start, length, words, keep_doc, keep))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], pa.int64()) for k in range(6)],
            names=["row", "start", "length", "words", "keep_doc_id", "keep_start"])

    return in_arrow(
        both, "row long, start long, length long, words long, keep_doc_id long, keep_start long", make)


SPANS = "array<struct<start:long,length:long,keep_doc_id:long,keep_start:long>>"


def cut(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, clean_text, removed_chars and spans (start, length, keep_doc_id, keep_start) of each row
    of `numbered`. Spans that overlap are removed once."""
    spans = stage(spans)
    lists = spans.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", "length", "keep_doc_id", "keep_start"))).alias("spans"))
    few = spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lists = F.broadcast(lists) if few else stage(lists)

    def make(batch):
        clean, lost = [], []
        for body, removed in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
            parts, at = [], 0
            for s in removed or ():
                parts.append(body[at : s["start"]])
                at = max(at, s["start"] + s["length"])
            whole = body if not removed else "".join([*parts, body[at:]])
            clean.append(whole)
            lost.append(len(body or "") - len(whole or ""))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(clean, pa.string()), pa.array(lost, pa.int64()), batch["spans"]],
            names=["doc_id", "clean_text", "removed_chars", "spans"])

    return in_arrow(
        rows.select("row", "doc_id", "text").join(lists, "row", "left"),
        f"doc_id long, clean_text string, removed_chars long, spans {SPANS}", make)


def without_repeats(
    docs: DataFrame, unit_words: int = UNIT_WORDS, passage_words: int = PASSAGE_WORDS,
    shared_words: int = 0, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """`cut` for each row of `docs`; columns other than id and text are not read."""
    rows = numbered(docs, id, text)
    return cut(rows, repeats(rows, unit_words, passage_words, shared_words))
