import hashlib
import random
from collections import defaultdict

from fairledger.llm import exact_dedup


def brute(rows, largest):
    groups = defaultdict(list)
    for id, text in rows:
        groups[(text or "").encode().lower()].append(id)
    out = []
    for id, text in rows:
        body = (text or "").encode().lower()
        ids = [i for i in groups[body] if i is not None]
        keep = (max if largest else min)(ids) if ids else None
        out.append((id, keep, len(groups[body]), id is not None and id == keep,
                    hashlib.sha256(body).hexdigest()))
    return sorted(out, key=repr)


ROWS = [
    (5, "One text"), (3, "ONE TEXT"), (9, "one  text"), (1, "Ärger"), (2, "ärger"), (4, None),
    (6, ""), (None, ""), (7, "x" * 300_000), (8, "x" * 300_000), (8, "x" * 300_000), (None, "alone"),
    (10, "one"), (11, "on"), (12, "o"),
]


def test_groups_and_odd_rows(spark, make_docs):
    for largest in (True, False):
        got = exact_dedup.exact_duplicates(
            make_docs(ROWS), "largest" if largest else "smallest").collect()
        assert sorted(map(tuple, got), key=repr) == brute(ROWS, largest)


def test_empty_table(spark, make_docs):
    assert exact_dedup.exact_duplicates(make_docs([])).count() == 0


def test_small_budget_gives_the_same(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = exact_dedup.exact_duplicates(corpus, "largest", budget=20_000).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, True)


def test_trie_spills_whole_subtrees():
    random.seed(4)
    texts = ["".join(random.choices("ab", k=random.randint(0, 12))).encode() for _ in range(3000)]
    trie, out = exact_dedup.Patricia(budget=40_000), defaultdict(list)
    gone = defaultdict(list)
    for rank, text in enumerate(texts):
        if not trie.insert(text, rank, 1):
            gone[text].append((rank, 1))
        while trie.full():
            for t, r, c in trie.spill():
                gone[t].append((r, c))
    for t, r, c in trie.owners():
        out[t].append((r, c))
    assert gone and out and not set(gone) & set(out)
    everything = {t: (min(r for r, _ in v), sum(c for _, c in v)) for t, v in [*out.items(), *gone.items()]}
    want = {}
    for rank, text in enumerate(texts):
        first, n = want.get(text, (rank, 0))
        want[text] = (first, n + 1)
    assert everything == want
