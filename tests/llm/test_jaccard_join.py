import random

import numpy as np
import pytest

from fairledger.llm import jaccard_join as J
from fairledger.llm.common import shingles
from fairledger.llm.components import components


def brute(rows, width, num, den):
    sets = [set(shingles((t or "").encode().lower().split(), width).tolist()) for _, t in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * den >= (len(sets[i]) + len(sets[j]) - both) * num:
                name[root(i)] = root(j)
    best = {}
    for i, (id, _) in enumerate(rows):
        if id is not None:
            best[root(i)] = min(best.get(root(i), id), id)
    return sorted(
        ((id, len(sets[i]), best.get(root(i)) if sets[i] else id) for i, (id, _) in enumerate(rows)),
        key=repr)


def near_copies(seed, groups=12, words=(3, 5, 12, 40, 160)):
    random.seed(seed)
    rows, id = [], 1000
    for _ in range(groups):
        base = [f"w{random.randint(0, 3000)}" for _ in range(random.choice(words))]
        for _ in range(random.randint(1, 9)):
            copy = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 15))):
                copy[random.randrange(len(copy))] = f"x{random.randint(0, 9)}"
            id -= random.randint(1, 3)
            rows.append((id, " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed,width,similarity,small", [
    (1, 4, (85, 100), 64), (1, 4, (85, 100), 1), (2, 5, (4, 5), 1), (3, 1, (1, 2), 64)])
def test_links_are_complete(spark, make_docs, monkeypatch, seed, width, similarity, small):
    monkeypatch.setattr(J, "SMALL", small)  # families of two and more are large
    rows = near_copies(seed)
    got = J.near_duplicates(make_docs(rows), width, similarity).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width, *similarity)


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A B"), (6, "a b c"), (7, "a"), (8, "a"),
            (None, "long enough to have some shingles here"), (9, "long enough to have some shingles here"),
            (9, "long enough to have some shingles here"), (None, "no id has this text of words"),
            (10, "é É word word word word word"), (11, "word " * 30_000), (12, "word " * 29_000)]
    got = J.near_duplicates(make_docs(rows), 4, (85, 100)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85, 100)
    assert J.near_duplicates(make_docs([])).count() == 0
    assert [tuple(r) for r in J.near_duplicates(make_docs([(1, None)])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("small", [64, 1])
def test_rows_without_id_are_bridges(spark, make_docs, monkeypatch, small):
    monkeypatch.setattr(J, "SMALL", small)
    copy = lambda k: " ".join([f"x{i}" for i in range(k)] + [f"w{i}" for i in range(k, 120)])
    rows = [(1, copy(5)), (None, copy(9)), (None, copy(9)), (2, copy(13)), (None, copy(17)), (3, "else")]
    got = J.near_duplicates(make_docs(rows), 4, (85, 100)).collect()
    want = brute(rows, 4, 85, 100)
    assert (2, 117, 1) in want and sorted(map(tuple, got), key=repr) == want


def test_sets_aside_are_met_from_other_partitions(spark, make_docs, monkeypatch):
    texts = ["a b c d", *(" ".join(f"w{i}" for i in range(n)) for n in (60, 63))]
    sets = [shingles(t.encode().split(), 4) for t in texts]
    (small, aside, other), n = map(J._digest, sets), [len(s) for s in sets]
    # one partition has two sets of the key and neither looks, the other has one that does
    rows = [(5, 0, small, n[0], False, True), (5, aside | 1, aside, n[1], False, True),
            (5, 0, other, n[2], True, False)]
    found = spark.createDataFrame(
        rows, "key long, salt long, sid long, n int, look boolean, many boolean").toArrow().to_batches()

    def index(*_):
        def run(batches):
            if sum(b.num_rows for b in batches):
                yield from found
        return run

    monkeypatch.setattr(J, "_index", index)
    docs = make_docs(list(enumerate(texts))).select("doc_id", "text").coalesce(1)
    sized = spark.createDataFrame(
        [(i, J._digest(s), len(s)) for i, s in enumerate(sets)], "doc_id long, sid long, n long")
    got = J.links(docs, 4, 85, 100, sized).collect()
    assert {frozenset(r) for r in got} == {frozenset((aside, other))}


def test_signatures_meet_all_similar_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        drop, add = int(rng.integers(0, len(x) // 5 + 1)), int(rng.integers(0, len(x) // 5 + 1))
        y = np.unique(np.concatenate([
            rng.permutation(x)[drop:], rng.integers(0, 1 << 60, add).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or both * 5 < (len(x) + len(y) - both) * 4:
            continue
        large, less = (x, y) if len(x) >= len(y) else (y, x)
        lows = J._bands(4, 5, 400)
        key, look = J.signatures(large, 4, 5, lows)
        other, _ = J.signatures(less, 4, 5, lows)
        assert set(key[look].tolist()) & set(other.tolist())


def test_hot_group_gives_few_pairs(spark, make_docs, monkeypatch):
    random.seed(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[random.randrange(200)] = f"y{i}"
        rows.append((i, " ".join(copy)))
    checked = []
    inner = J._verified

    def counted(pairs, *more):
        checked.append(pairs.count())
        return inner(pairs, *more)

    monkeypatch.setattr(J, "_verified", counted)
    got = J.near_duplicates(make_docs(rows), 4, (85, 100)).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(checked) < 4 * len(rows)


def test_large_family_near_the_bound(spark, make_docs):
    random.seed(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(random.randint(0, 6)):
            at = random.randrange(len(copy))
            copy[at : at + random.choice([0, 1, 1])] = [f"z{random.randint(0, 40)}"]
        rows.append((i, " ".join(copy)))
    got = J.near_duplicates(make_docs(rows), 4, (85, 100)).collect()
    want = brute(rows, 4, 85, 100)
    assert 3 < len({w[2] for w in want}) < 150 and sorted(map(tuple, got), key=repr) == want


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
