import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fairledger.llm import collocations as C


def brute_counts(rows, depth):
    counts = defaultdict(Counter)
    for text, lang in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, depth + 1):
                for k in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[k : k + size])] += 1
    return counts


def brute(rows, longest=3, least=10, top=2000, inside=50):
    out = []
    for lang, f in brute_counts(rows, longest).items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in some.items():
            if any(100 * b >= inside * a for q, b in some.items() if len(q) > len(p) and any(
                    q[k : k + len(p)] == p for k in range(len(q)))):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                 for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        n = sum(c for p, c in f.items() if len(p) == 1)
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s)
                for k, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


COLUMNS = "doc_id long, text string, lang string, n long, phrase string, rank int, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(1, t, g, 3, "x", 4, "h") for t, g in rows], COLUMNS)


def some_texts(seed, count=60, words=40):
    random.seed(seed)
    pool = ["a", "B", "ça", "É", "new", "york", "city", "x-1", "of"] + [f"w{k}" for k in range(12)]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "?!"]
    return [("".join(random.choice(pool) + random.choice(ends) for _ in range(words)) + " New York City",
             random.choice(["en", "fr", None, "und"])) for _ in range(count)]


@pytest.mark.parametrize("seed,options,shard", [
    (1, {}, C.SHARD_WORDS), (2, {"least": 3, "top": 7}, 100), (3, {"least": 2, "longest": 4, "inside": 80}, 300),
    (4, {"least": 2, "longest": 2}, 1)])
def test_phrases_are_those_of_plain_counting(spark, seed, options, shard):
    rows = some_texts(seed)
    got = C.collocations(frame(spark, rows).repartition(3), shard_words=shard, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, **options) != []


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" ,;\n", "en"), ("one", "en"), ("a b c " * 40_000, "fr"),
            ("a\x0bb\x0ca b", None), ("q r q r", "de"), ("é  " * 12, "de"),
            *[("Same text. Same text", "en")] * 6]
    got = C.collocations(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [(None, None)])).collect() == []


def test_scores_beyond_64_bits_are_exact(spark, monkeypatch):
    big = 9_007_199_254_740_993
    counts = spark.createDataFrame(
        [("en", "a b", big), ("en", "a", big + 2), ("en", "b", 3 * big), ("en", "", 9 * big)],
        "lang string, phrase string, n long")
    monkeypatch.setattr(C, "phrase_counts", lambda *_: counts)
    row = C.collocations(frame(spark, [])).collect()[0]
    assert row["score"] == 10**6 * big * big // ((big + 2) * 3 * big)


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_intervals_count_what_stands_in_the_sequence(depth):
    rng = np.random.default_rng(depth)
    ids = np.concatenate([[0], rng.integers(0, 6, 500), [0]]).astype(np.int32)
    want = Counter()
    for size in range(1, depth + 1):
        for k in range(len(ids) - size + 1):
            if all(ids[k : k + size]):
                want[tuple(ids[k : k + size].tolist())] += 1
    got = {}
    for words, n in C.phrases(ids, depth, lambda a, b: np.ones(len(a), bool)):
        got |= dict(zip(map(tuple, words.tolist()), n.tolist()))
    assert got == want
    wide = _order_of(ids, depth)
    assert (C._order(ids, depth) == wide).all()


def _order_of(ids, depth):
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
    return np.array(sorted(range(len(ids)), key=lambda k: tuple(padded[k : k + depth].tolist())))


def test_pairs_left_out_are_rare(spark):
    rows = frame(spark, some_texts(9)).selectExpr("coalesce(lang, 'und') as lang", "text")
    bits = C.pair_filter(C.pair_counts(rows), 10)
    assert 0 < sum(int(b).bit_count() for b in bits) < 1000
    assert C.passes(bits, np.array([2**63, 5], np.uint64)).dtype == bool
