import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fairledger.llm import components as C
from fairledger.llm import simhash_join as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42)
              for k in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=4):
    prints = [plain_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    low = {}
    for p, (id, _) in zip(part, rows):
        if id is not None:
            low[p] = min(low.get(p, id), id)
    return sorted(((id, f"{x:016x}", low.get(p)) for (id, _), x, p in zip(rows, prints, part)), key=repr)


def result(docs, **more):
    found = S.near_duplicates(docs, **more).select(
        "doc_id", S.hexadecimal(F.col("fingerprint")).alias("f"), "component_id")
    return sorted(map(tuple, found.collect()), key=repr)


def copies(seed, families, size, words):
    random.seed(seed)
    rows = []
    for _ in range(families):
        base = [f"w{random.randint(0, 900)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(words)] = f"x{random.randint(0, 99)}"
            rows.append((random.randint(0, 10**6), " ".join(copy)))
    return rows


@pytest.mark.parametrize("seed,families,size,words", [(1, 6, 12, 40), (2, 3, 30, 150), (3, 40, 3, 8)])
def test_components_are_those_of_all_pairs(spark, make_docs, seed, families, size, words):
    rows = copies(seed, families, size, words)
    assert result(make_docs(rows)) == brute(rows)


def test_odd_rows(spark, make_docs):
    long = " ".join(f"w{k}" for k in range(70_000))
    rows = [(5, None), (3, ""), (None, " \t\n\x0b"), (7, "One"), (8, "one"), (8, "one two"), (None, "one two"),
            (None, "alone of its kind here now"), (None, "É é é É é"), (9, "é é é é é"), (10, long),
            (11, long + " more"), (2, "a\x1cb c d e f"), (12, "a b c d " * 50), (1, "A B C D " * 49)]
    assert result(make_docs(rows)) == brute(rows)
    assert result(make_docs([])) == []
    assert result(make_docs([(None, None)])) == [(None, "0" * 16, None)]


def plain_links(values, bits):
    return {(a, b) for a in values for b in values if a < b and ((a ^ b) % 2**64).bit_count() <= bits}


@pytest.mark.parametrize("bits,full", [(4, 1024), (4, 3), (2, 2), (0, 1)])
def test_no_link_is_lost_in_full_cells(spark, bits, full):
    random.seed(bits + full)
    values = {0, -1, 1, -(2**63), 2**63 - 1}
    for center in [random.getrandbits(64) for _ in range(4)]:
        for _ in range(60):
            x = center
            for _ in range(random.randint(0, 5)):
                x ^= 1 << random.randrange(64 if random.random() < 0.5 else 12)
            values.add(x - 2**64 if x >> 63 else x)
    nodes = spark.createDataFrame([(x,) for x in values], "x long")
    got = [tuple(r) for r in S.links(nodes, bits, full).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_links(values, bits)


def test_manhattan_distance_is_a_lower_bound(spark):
    random.seed(5)
    pairs = [(random.getrandbits(63), random.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", F.bit_count(S.embedding(F.col("a")).bitwiseXOR(S.embedding(F.col("b")))).alias("l1"))
    for a, b, l1 in df.collect():
        ones = lambda x: [(x >> k & 3).bit_count() for k in range(0, 64, 2)]
        assert l1 == sum(abs(p - q) for p, q in zip(ones(a), ones(b))) <= (a ^ b).bit_count()
    for blocks in (5, 6, 8, 16):
        assert len(S.masks(blocks, 4, 2)) == S.comb(blocks, 4)


@pytest.mark.parametrize("task_links", [500_000, 40])
def test_thinned_links_connect_the_same(spark, monkeypatch, task_links):
    monkeypatch.setattr(C, "TASK_LINKS", task_links)
    random.seed(4)
    pairs = [(g * 1000 + random.randrange(30), g * 1000 + random.randrange(30)) for g in range(5) for _ in range(90)]
    links = spark.createDataFrame(pairs, "a long, b long")
    some = C.thinned(links)
    assert some.count() < (150 if task_links > 1000 else 450)
    parts = [dict(map(tuple, C.components(x).collect())) for x in (links, some)]
    assert parts[0] == parts[1]
