"""How the tokens of two tokenizers lie on the bytes of each text.

**Incidence.** Both tokenizers cut the same bytes, so each gives a sparse matrix of its tokens by
bytes, built here as compressed rows: where each row begins, and its columns. Gustavson's product
of A's matrix with the transpose of B's takes, for each row of A, the rows of the other matrix that
its columns name, and sums what falls on one place: token i of A and token j of B overlap in so
many bytes as the product says. Bytes where both end a token cut the text into groups; the product of
the matrices of tokens by groups links all tokens of A and B that share a group. Its size is known
from the row lengths alone, which is the symbolic half of the product.

Texts are laid one after the other into blocks of about a megabyte, and products are made of stretches
that end where a group ends, so a text of any length takes bounded memory for its matrices.

**Corpus.** A text's linked id pairs travel as arrays with their multiplicities in one written table.
Spark counts in how many texts each pair is linked; the table of pairs is broadcast up to
`BROADCAST_ROWS` rows, as it is bounded by the vocabularies but not small for all of them.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.llm.common import BROADCAST_ROWS, slices, texts
from fairledger.plans.staging import stage

#: Bytes of text whose matrices are held at once.
BLOCK = 1 << 20
#: How byte-level vocabularies cut a text before merging: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE in a JSON file. A blank is put before the text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        letters, vocabulary = byte_letters(), model["model"]["vocab"]
        self.ranks = {
            bytes(letters[c] for c in token): id for token, id in vocabulary.items() if token not in special}
        if model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: not a byte-level vocabulary that leaves blanks to the caller")
        merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["model"]["merges"])
        if any(vocabulary[token] != 256 + k for k, token in enumerate(merged)):
            raise ValueError(f"{path}: ids are not in the order of merges")

    @cached_property
    def _encoding(self):
        import tiktoken

        return tiktoken.Encoding(
            "byte_bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def __getstate__(self):
        return {"ranks": self.ranks}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._encoding.encode_ordinary(" " + text), np.int32)

    def token_bytes(self) -> list[bytes]:
        found = [b""] * (max(self.ranks.values()) + 1)
        for token, id in self.ranks.items():
            found[id] = token
        return found


class PieceBpe:
    """A sentencepiece model with byte fallback, which puts a blank before the text itself."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.model = file.read()

    @cached_property
    def _processor(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    def __getstate__(self):
        return {"model": self.model}

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._processor.encode(text), np.int32)

    def token_bytes(self) -> list[bytes]:
        sp = self._processor
        pieces = ((id, sp.id_to_piece(id)) for id in range(sp.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if sp.is_byte(id) else p.replace("▁", " ").encode()
                for id, p in pieces]


@dataclass
class Rows:
    """A sparse matrix of zeros and ones: row r has the columns `columns[start[r]:start[r + 1]]`."""

    start: np.ndarray
    columns: np.ndarray
    width: int

    def lengths(self) -> np.ndarray:
        return np.diff(self.start)

    def transposed(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        row = np.repeat(np.arange(len(self.start) - 1), self.lengths())
        counts = np.bincount(self.columns, minlength=self.width)
        return Rows(np.concatenate([[0], np.cumsum(counts)]), row[order], len(self.start) - 1)

    def size_of_product(self, other: Rows) -> int:
        """How many products of entries `times` adds up."""
        return int(other.lengths()[self.columns].sum())

    def times(self, other: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, value) of the places of the product that aren't zero, in order."""
        lengths = other.lengths()[self.columns]
        row = np.repeat(np.repeat(np.arange(len(self.start) - 1), self.lengths()), lengths)
        begin = np.repeat(other.start[self.columns] - (np.cumsum(lengths) - lengths), lengths)
        key = row * other.width + other.columns[np.arange(len(begin)) + begin]
        if (key[1:] < key[:-1]).any():
            key = np.sort(key, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.arange(0)
        row, column = np.divmod(key[at], max(1, other.width))
        return row, column, np.diff(np.append(at, len(key)))


def by_bytes(lengths: np.ndarray) -> Rows:
    """Tokens by bytes, of tokens that follow each other."""
    start = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(start, np.arange(start[-1]), int(start[-1]))


def by_groups(ends: np.ndarray, common: np.ndarray) -> Rows:
    """Tokens by groups, of which each token has one; `common` are the ends of groups."""
    return Rows(np.arange(len(ends) + 1), np.searchsorted(common, ends), len(common))


@dataclass
class Aligned:
    """Tokens of a run of texts: ids and ends of both sides, in bytes from the run's beginning."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray

    @cached_property
    def common(self) -> np.ndarray:
        return np.intersect1d(self.ends_a, self.ends_b, assume_unique=True)

    def _stretches(self):
        """(first, last + 1) tokens of A and of B in stretches of groups of about `BLOCK` bytes."""
        done = 0
        while done < len(self.common):
            base = self.common[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(self.common, base + BLOCK, "right")))
            ends = self.common[[done - 1, upto - 1]] if done else np.array([0, self.common[upto - 1]])
            yield *(np.searchsorted(e, ends, "right") for e in (self.ends_a, self.ends_b)), int(ends[0])
            done = upto

    def overlaps(self):
        """(token of A, token of B, shared bytes) of all that overlap, by stretches."""
        for (a0, a1), (b0, b1), base in self._stretches():
            a = by_bytes(np.diff(self.ends_a[a0:a1], prepend=base))
            b = by_bytes(np.diff(self.ends_b[b0:b1], prepend=base))
            row, column, shared = a.times(b.transposed())
            yield row + a0, column + b0, shared

    def group_rows(self) -> tuple[Rows, Rows]:
        return by_groups(self.ends_a, self.common), by_groups(self.ends_b, self.common)


def _written(a: ByteBpe, b: PieceBpe) -> tuple[pa.Array, int]:
    """`12,` and `12|` of A's ids, then `12,` and `12;` of B's; where B's begin."""
    sizes = len(a.token_bytes()), len(b.token_bytes())
    marks = [f"{id}{mark}".encode() for size, pair in zip(sizes, (",|", ",;"))
             for id in range(size) for mark in pair]
    return pa.array(marks, pa.binary()), 2 * sizes[0]


class _Aligner:
    """Encodes texts on an executor; made once for each task."""

    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.tables = [pa.array(t.token_bytes(), pa.binary()) for t in (a, b)]
        self.lengths = [pc.binary_length(t).to_numpy() for t in self.tables]
        self.marks, self.second = _written(a, b)

    def encode(self, text: bytes):
        """Ids of both sides; None for a text without tokens."""
        if not text:
            return None
        body, read, found = b" " + text, text.decode("utf-8", "replace"), []
        for side, table, lengths in zip((self.a, self.b), self.tables, self.lengths):
            ids = side.encode(read)
            size = int(lengths[ids].sum())
            if size != len(body):
                return None
            # bytes of an Arrow buffer are signed to Python, and would not equal those of `body`
            if memoryview(table.take(pa.array(ids)).buffers()[2]).cast("B")[:size] != body:
                return None
            found.append(ids)
        return found

    def runs(self, bodies: list[bytes]):
        """(number of texts, places of those with tokens, first tokens of these, `Aligned`) of runs
        of about `BLOCK` bytes."""
        held, places, size, count = [], [], 0, 0
        for text in bodies:
            if (found := self.encode(text)) is not None:
                held.append(found)
                places.append(count)
                size += len(text) + 1
            count += 1
            if size >= BLOCK:
                yield count, *self._run(held, places)
                held, places, size, count = [], [], 0, 0
        if count:
            yield count, *self._run(held, places)

    def _run(self, held, places):
        sides = [np.concatenate([np.empty(0, np.int32), *(h[k] for h in held)]) for k in (0, 1)]
        starts = [np.cumsum([0, *(len(h[k]) for h in held)]) for k in (0, 1)]
        ends = [np.cumsum(self.lengths[k][sides[k]], dtype=np.int64) for k in (0, 1)]
        return np.array(places, np.int64), starts, Aligned(*sides, *ends)

    def groups_text(self, run: Aligned, starts) -> pa.Array:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        a, b = run.group_rows()
        in_a, in_b = (np.bincount(g.columns, minlength=g.width) for g in (a, b))
        last_a = np.concatenate([a.columns[1:] != a.columns[:-1], [True]])[: len(run.ids_a)]
        last_b = np.concatenate([b.columns[1:] != b.columns[:-1], [True]])[: len(run.ids_b)]
        mark = np.empty(len(run.ids_a) + len(run.ids_b), np.int32)
        mark[np.arange(len(run.ids_a)) + (np.cumsum(in_b) - in_b)[a.columns]] = 2 * run.ids_a + last_a
        mark[np.arange(len(run.ids_b)) + np.cumsum(in_a)[b.columns]] = self.second + 2 * run.ids_b + last_b
        offsets = pa.array(starts[0] + starts[1], pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.marks.take(pa.array(mark))), b"")


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, "
    "groups_sha256 string, pair_a array<int>, pair_b array<int>, times array<int>"
)


def _spread(count: int, places: np.ndarray, values) -> pa.Array:
    full = np.zeros(count, np.int64)
    full[places] = values
    return pa.array(full)


def alignments(
    docs: DataFrame, a: ByteBpe, b: PieceBpe, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of `docs` with the columns of `ALIGNED`.

    n_links counts the overlapping pairs of tokens, n_shared those that share a group. pair_a, pair_b
    and times are the distinct linked pairs of ids and how often each is linked. Texts that are null
    or empty, and those that a tokenizer does not give back byte for byte, have no tokens.
    """
    def make(batches):
        aligner = _Aligner(a, b)
        for batch in slices(batches):
            done, ids = 0, batch["doc_id"]
            for count, places, starts, run in aligner.runs(texts(batch["text"])):
                yield _row_batch(aligner, ids.slice(done, count), count, places, starts, run)
                done += count

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(make, ALIGNED)


def _row_batch(aligner, ids, count, places, starts, run) -> pa.RecordBatch:
    texts_here = len(places)
    size_b = len(aligner.lengths[1])
    pair_base = len(aligner.lengths[0]) * size_b
    links, pairs, times = np.zeros(texts_here, np.int64), [], []
    for x, y, _ in run.overlaps():
        of = np.searchsorted(starts[0], x, "right") - 1
        links += np.bincount(of, minlength=texts_here)
        found = np.unique(of * pair_base + run.ids_a[x].astype(np.int64) * size_b + run.ids_b[y],
                          return_counts=True)
        pairs.append(found[0])
        times.append(found[1])
    if len(pairs) > 1:  # a text may lie in several stretches
        keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(times)).astype(np.int64)
    else:
        keys, n = (pairs[0], times[0]) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    of, pair = np.divmod(keys, pair_base)
    offsets = np.zeros(count + 1, np.int64)
    np.add.at(offsets, places[of] + 1, 1)
    offsets = pa.array(np.cumsum(offsets), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32)))
             for v in (pair // size_b, pair % size_b, n)]
    of_group = np.searchsorted(run.ends_a[starts[0][1:] - 1], run.common) if texts_here else places
    sizes = [np.bincount(g.columns, minlength=g.width) for g in run.group_rows()]
    shared = np.bincount(of_group, weights=sizes[0] * sizes[1], minlength=texts_here)
    digests = np.full(count, "", object)
    if texts_here:
        digests[places] = [hashlib.sha256(memoryview(t.as_buffer())[:-1]).hexdigest()
                           for t in aligner.groups_text(run, starts)]
    columns = [
        ids, *(_spread(count, places, v) for v in (
            np.diff(starts[0]), np.diff(starts[1]), np.bincount(of_group, minlength=texts_here), links,
            shared.astype(np.int64))),
        pa.array(digests, pa.string()), *lists,
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])


def token_links(
    docs: DataFrame, a: ByteBpe, b: PieceBpe, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per pair of tokens that overlap: doc_id, place_a, place_b (from 0), id_a, id_b, bytes.

    Texts without tokens, see `alignments`, give none.
    """
    names = ["doc_id", "place_a", "place_b", "id_a", "id_b", "bytes"]

    def make(batches):
        aligner = _Aligner(a, b)
        for batch in slices(batches):
            done, ids = 0, batch["doc_id"]
            for count, places, starts, run in aligner.runs(texts(batch["text"])):
                for x, y, shared in run.overlaps():
                    of = np.searchsorted(starts[0], x, "right") - 1
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(done + places[of])), pa.array(x - starts[0][of]),
                        pa.array(y - starts[1][of]), pa.array(run.ids_a[x], pa.int64()),
                        pa.array(run.ids_b[y], pa.int64()), pa.array(shared, pa.int64())], names=names)
                done += count

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(make, ", ".join(f"{n} long" for n in names))


def pair_table(aligned: DataFrame) -> DataFrame:
    """a, b, n (rows that hold the pair linked) and best (no pair of this a has a larger n)."""
    counts = stage(aligned.select(F.explode(F.arrays_zip("pair_a", "pair_b")).alias("p")).groupBy(
        F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return stage(counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(
    docs: DataFrame, a: ByteBpe, b: PieceBpe, id: str = "doc_id", text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256, n_shared.

    count_sum adds up the corpus counts of the id pairs of all links, n_best counts the links whose
    pair has the highest count of its A id. Rows that repeat an id or a text are each a document;
    null ids stay null; texts without tokens have zeros and '' as digest; an empty table gives none;
    other columns are not read.
    """
    aligned = stage(alignments(docs, a, b, id, text).withColumn("row", F.monotonically_increasing_id()))
    pairs = pair_table(aligned)
    if pairs.limit(broadcast_rows + 1).count() <= broadcast_rows:
        pairs = F.broadcast(pairs)
    each = aligned.select("row", F.explode(F.arrays_zip("pair_a", "pair_b", "times")).alias("p")).select(
        "row", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"),
        F.col("p.times").cast("long").alias("times"))
    sums = each.join(pairs, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return aligned.drop("pair_a", "pair_b", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"),
        "groups_sha256", "n_shared")
