"""Join of documents by the Jaccard similarity of their word n-grams, exact.

**Signatures.** A set of n-grams belongs to a size band. The universe is dealt by hash into as many
segments as the band's largest difference |x - y| + |y - x| of two similar sets, plus a few. By the
pigeonhole principle similar sets agree in a segment, and if a segment may differ by one element,
that stands for two. So of x's segments any choice covers all partners that counts H + 1, where H
is the largest difference of x from a similar set no larger than x, a segment to be met exactly
counting 1 and one to be met up to one element counting 2. Which ones x looks up is chosen by cost:
a segment of few elements is the same in very many sets, so the largest segments come first, and a
one-deletion lookup replaces the two dearest exact ones where it is cheaper. All segments of a set
are indexed in its own band, with their one-deletion neighbourhoods in the few segments that serve
for that; a set near the lower end of its band also looks up the band below.

The signature of a segment is the sum of its elements' hashes, so a deletion is a subtraction. A
collision can only add a candidate: every pair is verified on its sets.

**Buckets.** Sets with the same elements are one (64-bit digest of the set). In an input partition
all sets of a signature but the smallest are set aside already, each under a key of its own, so no
signature has more rows in one task than there are input partitions. Only shared ones are kept.

**Links.** Sets that share signatures, directly or through others, are a family. In a family of a few
sets all pairs that share a signature are verified. In a large one, such as thousands of copies with
a few changes each, most pairs share signatures and only few are similar. There sets are compared by
how they differ from what most of the family have in common, see `_within`: one comparison with the
set nearest to that, and a join on the rarest differences. No link that connects sets is lost.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fairledger.llm.common import (
    BROADCAST_ROWS, in_arrow, keep_ids, mix, shingles, slices, texts,
)
from fairledger.llm.components import components
from fairledger.plans.staging import stage

GROWTH = 1.6
#: Signatures of an input partition that are grouped at once.
BUFFER = 1_000_000
#: Sets of a family up to which all pairs that share a signature are verified.
SMALL = 64


def _bands(num: int, den: int, upto: int) -> list[int]:
    """Smallest sizes of the bands; a similar set is in the same band or the next."""
    growth, lows = max(GROWTH, 1.05 * den / num), [1]
    while lows[-1] <= upto:
        lows.append(max(lows[-1] + 1, int(lows[-1] * growth)))
    return lows


def difference(larger: int, smaller: int, num: int, den: int) -> int:
    """Most elements that are in one only of two sets with a similarity of num / den or more."""
    return (larger + smaller) * (den - num) // (den + num)


@functools.lru_cache(maxsize=64)
def _scheme(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """Segments of the band low .. high, and how many have one-deletion neighbourhoods."""
    most = difference(high * den // num, high, num, den)
    return most + 1 + (most > 0) + most // 16, (most > 0) + most // 24


def _choose(sizes: np.ndarray, deletable: int, need: int) -> tuple[np.ndarray, int]:
    """Segments to meet exactly, and how many of the first are met up to one deletion.

    A segment of z elements is taken to be shared by a share of 8^-z of the sets.
    """
    order = np.argsort(-sizes, kind="stable")
    chosen, taken = [], 0
    for d in range(deletable + 1):
        rest = max(0, need - 2 * d)
        exact = order[order >= d][:rest] if d else order[:rest]
        if len(exact) < rest:
            continue
        z = sizes[:d].astype(float)
        cost = np.sum((z + 1) * 8.0 ** (1 - z)) + np.sum(8.0 ** -sizes[exact].astype(float))
        chosen.append((cost, d, exact))
    _, taken, exact = min(chosen, key=lambda c: (c[0], c[1]))
    return exact, taken


def signatures(
    elements: np.ndarray, num: int, den: int, lows: list[int],
) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and which of them it looks up."""
    n = len(elements)
    band = int(np.searchsorted(lows, n, side="right")) - 1
    keys, looks = [], []
    below = band > 0 and n * num <= (lows[band] - 1) * den
    place, worth = mix(elements), mix(elements + np.uint64(0x51ED270B35AE5D97))
    for b in [band, band - 1] if below else [band]:
        low, high = lows[b], lows[b + 1] - 1
        m, d = _scheme(low, high, num, den)
        segment = (place % np.uint64(m)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], worth[order]
        sizes = np.bincount(segment, minlength=m)
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        total = sums[ends] - sums[ends - sizes]
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(b << 32))
        exact, taken = _choose(sizes, d, difference(n, min(n, high), num, den) + 1)
        own = np.zeros(m, bool)
        own[exact] = own[:taken] = True
        drop = int(ends[d - 1]) if d else 0
        at = segment[:drop]
        fewer = mix(total[at] - value[:drop] + salt[at])
        key = mix(total + salt)
        if b == band:
            keys += [key, fewer]
            looks += [own, at < taken]
        else:
            keys += [key[own], fewer[at < taken]]
            looks += [np.ones(int(own.sum()), bool), np.ones(int((at < taken).sum()), bool)]
    return np.concatenate(keys), np.concatenate(looks)


def _digest(elements: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(elements.tobytes()))))


def _words(body: bytes) -> list[bytes]:
    return body.lower().split()  # ASCII only: A-Z, and white space x20 x09-x0D


def _sizes(width: int):
    def make(batch):
        sets = [shingles(_words(t), width) for t in texts(batch["text"])]
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"],
            pa.array([_digest(s) if len(s) else None for s in sets], pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
        ], names=["doc_id", "sid", "n"])

    return make


def _sets(width: int):
    def make(batch):
        sets = [shingles(_words(t), width) for t in texts(batch["text"])]
        yield pa.RecordBatch.from_arrays([
            pa.array([_digest(s) for s in sets], pa.int64()),
            pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
        ], names=["sid", "elements"])

    return make


def _index(width: int, num: int, den: int):
    """Rows (key, salt, sid, n, look, many): one without salt for each key, others set aside."""
    def flush(parts):
        key, sid, n, look = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((~look, sid, key))
        key, sid, n, look = key[order], sid[order], n[order], look[order]
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new = new_key.copy()
        new[1:] |= sid[1:] != sid[:-1]
        key, sid, n, look, first = key[new], sid[new], n[new], look[new], new_key[new]
        start = np.flatnonzero(first)
        count = np.diff(np.append(start, len(key)))
        looked = np.repeat(np.logical_or.reduceat(look, start), count)
        many = np.repeat(count > 1, count)
        for at in range(0, len(key), 100_000):
            s = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(key[s].view(np.int64)), pa.array(np.where(first[s], 0, sid[s] | 1)),
                pa.array(sid[s]), pa.array(n[s].astype(np.int32)), pa.array(looked[s]),
                pa.array(many[s]),
            ], names=["key", "salt", "sid", "n", "look", "many"])

    def run(batches):
        parts, held, seen, lows = [], 0, set(), _bands(num, den, 64)
        for batch in slices(batches):
            for body in texts(batch["text"]):
                elements = shingles(_words(body), width)
                if not len(elements):
                    continue
                sid = _digest(elements)
                if sid in seen:
                    continue
                seen.add(sid)
                if len(elements) >= lows[-1]:
                    lows = _bands(num, den, len(elements))
                key, look = signatures(elements, num, den, lows)
                parts.append((
                    key, np.full(len(key), sid), np.full(len(key), len(elements)), look))
                held += len(key)
                if held >= BUFFER:
                    yield from flush(parts)
                    parts, held, seen = [], 0, set()
        if parts:
            yield from flush(parts)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar, by the intersection of their whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return stage(
        pairs.join(left, "a").join(right, "b")
        .withColumn("both", both)
        .where(F.col("both") * den >= (F.size("x") + F.size("y") - F.col("both")) * num)
        .select("a", "b")
    )


def _similar_size(num: int, den: int):
    return (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)


def links(docs: DataFrame, width: int, num: int, den: int, sized: DataFrame) -> DataFrame:
    """Links (a, b) between set ids that connect all similar sets of doc_id, text.

    `sized` has doc_id, sid and n of all rows, written.
    """
    found = docs.mapInArrow(
        _index(width, num, den),
        "key long, salt long, sid long, n int, look boolean, many boolean")
    same = Window.partitionBy("key", "salt")
    # each input partition with a key has a row without salt, so these know of all who look; what
    # was set aside where nobody looks waits for their answer
    shared = stage(
        found.withColumn("_rows", F.count(F.lit(1)).over(same))
        .withColumn("_look", F.max("look").over(same))
        .where("(_look or salt != 0) and (many or _rows > 1)")
        .select("sid", "key", "n", "_look", (F.col("salt") == 0).alias("_first"))
    )
    members = shared.where("_look").select("sid", "key", "n")
    waiting = shared.where("not _look")
    if not waiting.isEmpty():
        looked = stage(shared.where("_look and _first").select("key").distinct())
        members = members.unionByName(stage(
            waiting.join(looked, "key", "left_semi").select("sid", "key", "n")))
    needed = stage(members.select("sid").distinct())
    first = stage(sized.join(needed, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")))
    bodies = keep_ids(docs, first.where("doc_id is not null"), "doc_id")
    whole = in_arrow(bodies, "sid long, elements array<long>", _sets(width))
    nameless = first.where("doc_id is null")
    if not nameless.isEmpty():  # sets of which no row has an id are found by their digest
        whole = whole.unionByName(keep_ids(in_arrow(
            docs.where("doc_id is null"), "sid long, elements array<long>", _sets(width)),
            nameless, "sid"))
    sets = stage(whole.dropDuplicates(["sid"]))

    leader = stage(members.groupBy("key").agg(F.min("sid").alias("b")))
    families = stage(components(members.join(leader, "key").select(
        F.col("sid").alias("a"), "b")).select(F.col("node").alias("sid"), F.col("component").alias("family")))
    sizes = stage(families.groupBy("family").agg(F.count(F.lit(1)).alias("sets")))

    small = stage(members.join(families.join(sizes.where(F.col("sets") <= SMALL), "family").select(
        "sid"), "sid"))
    left, right = small.toDF("a", "key", "n"), small.toDF("b", "key", "m")
    pairs = left.join(right, "key").where("a < b").where(_similar_size(num, den)).select(
        "a", "b").distinct()
    large = sizes.where(F.col("sets") > SMALL)
    if not large.isEmpty():
        pairs = pairs.unionByName(_within(sets.join(families, "sid").join(large, "family"), num, den))
    return _verified(stage(pairs), sets, num, den)


def _by_element(rows: DataFrame, keep, every: bool) -> DataFrame:
    """(family, e, sid, c): the elements, with their numbers of sets, that `keep` wants.

    rows: family, sid, aux, items. Elements of an input batch travel as one array for each partition
    by element, so what is not wanted never becomes a row. `keep` gets the number of sets of each
    element and the sum of their aux. `every`: all rows of an element, else one.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["family", "sid", "aux", "e"]

    def deal(batch):
        items = batch["items"]
        size = pc.list_value_length(items).to_numpy(zero_copy_only=False)
        values = [np.repeat(batch[c].to_numpy(zero_copy_only=False), size) for c in names[:3]]
        values.append(items.flatten().to_numpy(zero_copy_only=False))
        part = (mix(values[3].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        some = np.flatnonzero(np.diff(ends))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32))] + [
                pa.array([v[order[ends[p] : ends[p + 1]]].tobytes() for p in some], pa.binary())
                for v in values],
            names=["part", *names])

    def tally(table: pa.Table) -> pa.Table:
        family, sid, aux, e = (
            np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in names)
        order = np.lexsort((sid, e, family))
        family, sid, aux, e = family[order], sid[order], aux[order], e[order]
        start = np.flatnonzero(
            np.concatenate([[True], (family[1:] != family[:-1]) | (e[1:] != e[:-1])]))
        count = np.diff(np.append(start, len(e)))
        wanted = keep(count, np.add.reduceat(aux, start))
        rows = np.flatnonzero(np.repeat(wanted, count)) if every else start[wanted]
        return pa.table({
            "family": family[rows], "e": e[rows], "sid": sid[rows],
            "c": np.repeat(count, count)[rows] if every else count[wanted]})

    dealt = in_arrow(rows.select("family", "sid", "aux", "items"),
                     "part int, family binary, sid binary, aux binary, e binary", deal)
    return dealt.groupBy("part").applyInArrow(tally, "family long, e long, sid long, c long")


def _within(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) in large families that may be similar; with the similar ones among them, all
    similar sets of a family are connected. `sets` has sid, elements, family, sets.

    Sets are described by how they differ from a reference r, the elements that most sets of the
    family have: d(x) = x Δ r, and x Δ y = d(x) Δ d(y). With E(x) = |d(x)| (den + num) -
    (den - num) |x|, x and y are similar if and only if E(x) + E(y) <= 2 (den + num) |d(x) ∩ d(y)|.
    Let c have the smallest E. Similar sets without a common difference have E(x) + E(y) <= 0, so
    E(x) + E(c) <= 0 and both are similar to c: those links need no other pair. All other similar
    sets have a common difference, and the rarest one stands in d(x) at a place p that leaves
    |d(x)| - p elements, so that E(x) + E(y) <= 2 (den + num) min(|d(x)| - p, |d(y)| - q).
    """
    both, apart = den + num, den - num
    each = stage(sets.withColumn("n", F.size("elements")))
    common = _by_element(
        each.select("family", "sid", F.col("sets").alias("aux"), F.col("elements").alias("items")),
        lambda c, aux: 2 * c > aux // c, False)
    reference = common.groupBy("family").agg(F.collect_list("e").alias("r"))  # twice a mean set at most
    reference = stage(sets.select("family").distinct().join(reference, "family", "left").select(
        "family", F.coalesce("r", F.array().cast("array<long>")).alias("r")))
    apart_from = F.concat(F.array_except("elements", "r"), F.array_except("r", "elements"))
    diffs = stage(each.join(reference, "family").select(
        "family", "sid", "n", F.size("r").alias("r"), apart_from.alias("d")
    ).withColumn("k", F.size("d")).withColumn("over", F.col("k") * both - F.col("n") * apart))
    nearest = stage(diffs.groupBy("family").agg(F.min(F.struct("over", "sid")).alias("c")))
    diffs = diffs.join(nearest, "family").withColumn("linked", F.col("over") + F.col("c.over") <= 0)

    star = diffs.where("linked and sid != c.sid").select(
        F.col("sid").alias("a"), F.col("c.sid").alias("b"))

    # the smallest E of a set similar to x, by the sizes it may have
    size = F.greatest(F.ceil(F.col("n") * num / den), F.least(F.floor(F.col("n") * den / num), "r"))
    least = F.greatest("c.over", F.abs(size - F.col("r")) * both - size * apart)
    facts = stage(diffs.select("sid", "n", "over", "linked", least.alias("least")))
    often = _by_element(
        diffs.select("family", "sid", F.col("linked").cast("long").alias("aux"),
                     F.col("d").alias("items")),
        lambda c, aux: (c > 1) & (aux < c), True)
    # an element of no other set takes a place before all of these, and has no part in it
    own = Window.partitionBy("sid")
    placed = stage(
        often.withColumn("left", F.count(F.lit(1)).over(own) + 1 - F.row_number().over(
            own.orderBy("c", "e")))
        .join(facts, "sid")
        .where(2 * both * F.col("left") >= F.col("over") + F.col("least"))
        .select("family", "e", "sid", "n", "over", "linked", "left")
    )
    x = placed.where("not linked").drop("linked").toDF("family", "e", "a", "n", "over", "left")
    y = placed.toDF("family", "e", "b", "m", "over_b", "linked", "right")
    crossed = x.join(y, ["family", "e"]).where(
        (F.col("linked") | (F.col("a") < F.col("b"))) & _similar_size(num, den)
        & (F.col("over") + F.col("over_b") <= 2 * both * F.least("left", "right"))
    ).select("a", "b").distinct()
    return star.unionByName(crossed)


def near_duplicates(
    docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Words are runs without white space, A-Z lower-cased; a text of fewer than `width` words is one
    n-gram as a whole. `similarity` is a fraction. Two documents are linked when intersection /
    union of their sets reaches it; component_id is the smallest id reachable by links. Texts that
    are null, empty or without words have no n-grams and no links, and keep their own id. Rows that
    repeat an id get the component of their own text, null ids are linked but never name a
    component (it is null if no row has an id); an empty table gives none; other columns are not read.
    """
    joined = _joined(docs, width, similarity, id, text)
    names = stage(joined.where("_part is not null").groupBy("_part").agg(
        F.min("doc_id").alias("_name")))
    return joined.join(names, "_part", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("_part").isNull(), F.col("doc_id")).otherwise(F.col("_name")).alias(
            "component_id"),
    )


def _joined(
    docs: DataFrame, width: int, similarity: tuple[int, int], id: str, text: str,
) -> DataFrame:
    """One written row per row of `docs`: doc_id, sid, n, _part; the part is the smallest sid of its
    component, null without n-grams."""
    num, den = similarity
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sized = stage(in_arrow(rows, "doc_id long, sid long, n long", _sizes(width)))
    some = sized.where("sid is not null")
    found = components(links(rows, width, num, den, some))
    return stage(sized.join(
        found.select(F.col("node").alias("sid"), "component"), "sid", "left"
    ).withColumn("_part", F.coalesce("component", "sid")).select("doc_id", "sid", "n", "_part"))


def without_near_copies(
    docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (4, 5), id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of `docs` with one row of each group of linked ones, and all without n-grams.

    A row is known by its id and its set of n-grams, so other rows of its id have their own verdict.
    The row of smallest id and set stays, rows without id come last; of rows that agree in both the
    one whose text and other columns come first in order. Columns may have any name and type.
    """
    joined = _joined(docs, width, similarity, id, text).where("_part is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sid")
    first = stage(joined.groupBy("_part").agg(F.min(rank).alias("_first")))
    gone = stage(joined.join(first, "_part").where(rank != F.col("_first")).select("doc_id", "sid").distinct())
    twice = stage(joined.groupBy("doc_id", "sid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "doc_id", "sid"))

    def with_sid(batch):
        sets = [shingles(_words(t), width) for t in texts(batch["text"])]
        sids = pa.array([_digest(s) if len(s) else None for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], sids], names=["row", "doc_id", "sid"])

    # the columns of a row travel in one, so none of their names meets one of these
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = in_arrow(rows, StructType([rows.schema["row"], rows.schema["doc_id"], StructField("sid", LongType())]),
                     with_sid)

    def among(some, ids, how):
        if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        ids = ids.toDF("_id", "_set")
        return some.join(ids, some["doc_id"].eqNullSafe(ids["_id"]) & (some["sid"] == ids["_set"]), how)

    left = among(keyed, gone, "left_anti")
    if not twice.isEmpty():
        order = F.struct(F.col("row").getField(text), F.to_json(F.struct("row")))
        left = among(left, twice, "left_anti").select("row").unionByName(
            among(left, twice, "left_semi").groupBy("doc_id", "sid").agg(F.min_by("row", order).alias("row"))
            .select("row"))
    return left.select("row.*")
