from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from fairledger.llm import decontam, jaccard_join, mixing, sharding, toxicity
from fairledger.llm.common import shingles
from fairledger.plans.staging import folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(row):
    return repr(tuple(row))


def small_id_of_group(rows):
    """The smallest id of each row's group, by comparing all pairs."""
    sets = [set(shingles((r.text or "").encode().lower().split(), 5).tolist()) for r in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                name[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return [least[root(i)] if sets[i] else r.doc_id for i, r in enumerate(rows)]


def test_stages_against_brute_force(spark, corpus, small):
    docs = corpus
    rows = docs.collect()

    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    got = P.toxic_out(spark, docs, small)
    assert got.columns == COLUMNS
    rows = [r for r in rows if model.score(model.clauses(r.text)[None])[0] < 0.5]
    assert sorted(map(key, got.collect())) == sorted(map(key, rows))

    docs = got.cache()
    got = P.near_copies_out(spark, docs, small)
    rows = [r for r, least in zip(rows, small_id_of_group(rows)) if r.doc_id == least]
    assert got.columns == COLUMNS and sorted(map(key, got.collect())) == sorted(map(key, rows))

    docs = got.cache()
    got = P.leaks_out(spark, docs, small)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [grams(decontam.words(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert all(items)
    rows = [r for r in rows if not any(
        5 * len(g & grams(decontam.words(r.text))) >= 4 * len(g) for g in items)]
    assert got.columns == COLUMNS and sorted(map(key, got.collect())) == sorted(map(key, rows))

    docs = got.cache()
    got = P.mixed(spark, docs, small)
    taken = {r.doc_id: r for r in mixing.mix(docs, seed=P.MIX_SEED).collect()}
    want = [r for r in rows for _ in range(
        int(taken[r.doc_id].taken / taken[r.doc_id].size + 0.5) if taken[r.doc_id].size else 1)]
    assert got.columns == COLUMNS and sorted(map(key, got.collect())) == sorted(map(key, want))
    words = Counter()
    for r in want:
        words[r.source] += len((r.text or "").encode().split())
    longest = Counter()
    for r in rows:
        longest[r.source] = max(longest[r.source], len((r.text or "").encode().split()))
    for t in taken.values():
        assert abs(words[t.source] - t.target) <= mixing.BLOCK_WORDS + longest[t.source]

    docs = got.cache()
    got = P.sharded(spark, docs, small).collect()
    order = sorted((r.doc_id, len((r.text or "").encode()) + 1) for r in want)
    assert sorted((r.doc_id, r.size) for r in got) == order
    assert sorted(r.shard + 16 * r.slot for r in got) == list(range(len(want)))
    assert [r.shard + 16 * r.slot for r in got] == list(
        sharding.position([r.row_number for r in got], len(got), P.SHARD_SEED))


def test_run_is_its_stages(spark, small):
    assert [n for n, _ in P.STAGES] == [
        "toxicity", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    got = P.run(spark, small).collect()
    again = P.run(spark, small).collect()
    assert got and sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows_in_every_stage(spark, make_docs, small, stage):
    rows = [(1, None), (2, ""), (None, None), (None, "some words here and there and more"), (3, "x " * 100_000),
            (4, "the same text of some words twice"), (5, "the same text of some words twice"),
            (5, "the same text of some words twice", None), (6, "É" * 9, "ü")]
    make = P.STAGES[stage][1]
    out = make(spark, make_docs(rows), small)
    n = out.count()
    if stage < 4:
        assert out.columns == make_docs([]).columns
    assert n == {0: 9, 1: 7, 2: 9, 4: 9}.get(stage, n)
    assert make(spark, make_docs([]), small).count() == 0


def test_near_copies_with_and_without_id_are_one_group(spark, make_docs, small):
    text = "this text of eight words is there twice"
    got = P.near_copies_out(spark, make_docs([(None, text), (7, text), (8, text)]), small)
    assert [r.doc_id for r in got.collect()] == [7]
    sizes = jaccard_join.near_duplicates(make_docs([(7, text)])).select(F.col("n_shingles")).first()
    assert sizes[0] == 4


def test_verdicts_are_by_row(spark, make_docs, small):
    bad = "they hurt and kill you. they kill you! they destroy you!"
    item = next(r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()
                if len(decontam.words(r.text)) > 5)
    clean = "a clean text"
    for make, text in ((P.toxic_out, bad), (P.leaks_out, item)):
        rows = [(None, text), (5, text), (5, clean), (None, clean), (6, None)]
        got = make(spark, make_docs(rows), small).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == [(5, clean), (6, None), (None, clean)]


def test_one_row_of_near_copies_stays(spark, make_docs, small):
    x = "this text of eight words is there twice"
    y = "another text of more than eight words that comes again"
    z = "a third text that is only there in rows without any id"
    rows = [(3, y), (5, x), (9, x), (5, y), (5, x), (None, z), (None, z), (None, None), (None, "")]
    got = P.near_copies_out(spark, make_docs(rows), small).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(
        [(3, y), (5, x), (None, z), (None, None), (None, "")], key=repr)


def test_rows_alike_have_their_own_share(spark, make_docs, small):
    rows = [(None, " ".join(f"t{k}w{i}" for i in range(64)), "a") for k in range(100)]
    rows += [(None, "same words here", "b")] * 300 + [(k, "some other words of c " * 9, "c") for k in range(90)]
    docs = make_docs(rows)
    got = P.mixed(spark, docs, small).groupBy("source").agg(
        F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("words")).collect()
    want = {r.source: (r.target, r.size) for r in mixing.mix(docs, seed=P.MIX_SEED).collect()}
    assert {r.source for r in got} == set(want)
    for r in got:
        target, longest = want[r.source]
        assert abs(r.words - target) <= mixing.BLOCK_WORDS + longest


@pytest.mark.parametrize("stage", range(5))
def test_columns_of_any_name_and_type(spark, small, stage):
    names = ("_sid sid _id _times _size _source _part _row row rows doc copy times n key _key size shard slot"
             " _bucket _p _offset look cell").split()
    texts = ["they hurt and kill you. they kill you!", "a clean text of some words", "a clean text of some words", None]
    df = spark.createDataFrame(
        [(k, t, "en", "s", 1, {"m": k}, [k]) for k, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long, tags map<string,long>, list array<long>")
    df = df.select("*", *[F.lit("x").alias(n) for n in names])
    path = f"{folder(spark)}/odd-{stage}"
    df.write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    out = P.STAGES[stage][1](spark, docs, small)
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns) and (stage == 4 or out.columns == docs.columns)
    assert all(r.tags == {"m": r.doc_id} and r["_sid"] == "x" for r in rows)
    assert sorted(r.doc_id for r in rows) == {0: [1, 2, 3], 1: [0, 1, 3]}.get(stage, sorted(r.doc_id for r in rows))
