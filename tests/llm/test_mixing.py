import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from fairledger.llm import mixing


def one_by_one(votes, seats):
    given = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
        given[i] += 1
    return given


def test_sainte_lague_is_the_highest_quotients():
    random.seed(1)
    for _ in range(60):
        votes = [random.choice([0, 1, 5, 7.5, 100, 1000]) for _ in range(random.randint(1, 9))]
        for seats in (0, 1, 2, 7, 40, 333):
            assert list(mixing.sainte_lague(np.array(votes), seats)) == one_by_one(votes, seats)


def by_rounds(sizes, weights, repeats):
    out, fixed = [0.0] * len(sizes), set()
    while True:
        rest = sum(sizes) - sum(repeats * sizes[i] for i in fixed)
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        for i in open_:
            out[i] = rest * weights[i] / sum(weights[j] for j in open_)
        over = {i for i in open_ if out[i] > repeats * sizes[i]}
        if not over:
            return out
        fixed |= over
        for i in over:
            out[i] = repeats * sizes[i]


def test_targets_are_bounded_shares():
    random.seed(2)
    for _ in range(200):
        n = random.randint(1, 12)
        sizes = [random.choice([0, 1, 10, 500, 9000]) for _ in range(n)]
        weights = [i % 3 + 1 for i in range(n)]
        if not sum(sizes):
            continue
        got = mixing.targets(np.array(sizes), np.array(weights), 3)
        assert got == pytest.approx(by_rounds(sizes, weights, 3))


def test_quotas_of_shards():
    sources = pd.DataFrame({"source": ["b", None, "a"], "source_size": [1000, 10, 5000]})
    got = mixing.plan(sources, 10, 3, 4)
    assert list(got["source"]) == ["a", "b", None]
    assert got["target"].tolist() == pytest.approx([2990.0, 2990.0 + 0, 30.0], abs=1000)
    totals = np.array(got["quotas"].tolist())
    assert (np.diff(totals, axis=1) >= 0).all() and totals[:, -1].tolist() == got["blocks"].tolist()
    assert totals.sum(axis=0).tolist() == [601 * s // 4 for s in (1, 2, 3, 4)]


def test_taken_words_come_to_the_target(spark, make_docs):
    random.seed(3)
    rows = [(i, " ".join(["w"] * random.randint(0, 60)), random.choice("aaaab")) for i in range(300)]
    rows += [(300, None, "b"), (301, "", None), (None, "x y", None), (500, "again", "c"), (500, "again", "c")]
    got = mixing.mix(make_docs(rows), block_words=8).collect()
    assert len(got) == len(rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.first_shard is None) == (r.taken == 0)
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r.size
        assert r.size == len((dict((x[0], x[1]) for x in rows).get(r.doc_id) or "").split())
    for s in taken:
        assert abs(taken[s] - target[s]) <= 8 and target[s] <= 3 * size[s]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    again = mixing.mix(make_docs(rows).repartition(5), block_words=8).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_empty_and_wordless_tables(spark, make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mixing.mix(make_docs([(1, None)])).collect()] == [(0, 0.0, 0)]
