import math
from collections import Counter

import numpy as np
import pytest

from fairledger.llm import lm_score


def brute(rows, order, least):
    words = [[w for w in (t or "").encode().lower().split()] for _, t in rows]
    count = Counter()
    for ws in words:
        for n in range(1, order + 1):
            count.update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    size = sum(map(len, words))
    out = []
    for (id, _), ws in zip(rows, words):
        hits, total = [0] * order, 0.0
        for i in range(len(ws)):
            longest = min(order, i + 1)
            n = next(n for n in range(longest, 0, -1) if n == 1 or count[tuple(ws[i + 1 - n : i + 1])] >= least)
            hits[n - 1] += 1
            gram = tuple(ws[i + 1 - n : i + 1])
            total += (longest - n) * math.log(0.4) + math.log(
                count[gram] / (count[gram[:-1]] if n > 1 else size))
        out.append((id, len(ws), *hits, total, total / len(ws) if ws else None))
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert [g[:-2] for g in got] == [w[:-2] for w in want]
    assert [g[-2:] for g in got] == [pytest.approx(w[-2:], abs=1e-6) for w in want]


def test_what_travels_comes_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000):
        counts = np.where(rng.random(n) < 0.5, 1, rng.choice([2, 254, 255, 256, 1 << 40], n)).astype(np.int64)
        assert (lm_score.unpack_counts(lm_score.pack_counts(counts)) == counts).all()
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        keys = np.sort(keys[keys % np.uint64(7) == 3])
        assert (lm_score.unpack(lm_score.pack(keys, 7), 3, 7) == keys).all()


@pytest.mark.parametrize("order,least", [(2, 1), (3, 2), (4, 3)])
def test_scores(spark, corpus, order, least):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    same(lm_score.backoff_scores(corpus, order, least).collect(), brute(rows, order, least))


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A b a b A\tb\x0bc"), (None, "b a b"), (5, "é É"),
            (6, "a b " * 20_000), (4, "A b a b A\tb\x0bc")]
    same(lm_score.backoff_scores(make_docs(rows)).collect(), brute(rows, 3, 2))
    assert lm_score.backoff_scores(make_docs([])).count() == 0
    assert [tuple(r) for r in lm_score.backoff_scores(make_docs([(1, None)])).collect()] == [
        (1, 0, 0, 0, 0, 0.0, None)]


def test_blocks_go_by_bytes_not_by_partitions(spark, corpus, monkeypatch):
    setting, seen = "spark.sql.shuffle.partitions", []
    old = spark.conf.get(setting)
    try:
        for n in (2, 50):
            spark.conf.set(setting, str(n))
            seen.append(lm_score.parts_of(corpus))
    finally:
        spark.conf.set(setting, old)
    assert seen[0] == seen[1]
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 20_000)
    assert lm_score.parts_of(corpus) > 10
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    same(lm_score.backoff_scores(corpus).collect(), brute(rows, 3, 2))
