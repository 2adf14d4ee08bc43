import zlib

import numpy as np
import pytest

from fairledger.llm import sharding


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation_and_inverse(size):
    p = sharding.position(np.arange(size), size, seed=3)
    assert sorted(p) == list(range(size))
    assert list(sharding.row_number(p, size, seed=3)) == list(range(size))
    if size > 100:
        assert list(p) != list(range(size))
        assert list(p) != list(sharding.position(np.arange(size), size, seed=4))


def test_shards_are_gapless_and_even(spark, make_docs):
    rows = [(i % 40, "same" if i % 3 else None) for i in range(100)] + [(None, "é"), (None, "")]
    got = sharding.shard(make_docs(rows), 16, 5).collect()
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1) for i, t in rows if i is not None)
    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t in rows}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r.shard + 16 * r.slot for r in got] == list(
        sharding.position([r.row_number for r in got], len(rows), 5))


def test_same_on_other_partitions(spark, corpus):
    one = sharding.shard(corpus.coalesce(1)).collect()
    other = sharding.shard(corpus.repartition(7, "text")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_empty_table(spark, make_docs):
    assert sharding.shard(make_docs([])).count() == 0
