from pyspark.sql import functions as F

from fairledger.llm import toxicity as T


def model():
    return T.Model({"idiot": "insult", "trash": "insult", "bogg": "slur"})


def test_clauses_by_their_heaviest_symbol():
    m = model()
    count = lambda text: dict(zip(T.SYMBOLS, m.clauses(text).astype(int).tolist()))
    none = dict.fromkeys(T.SYMBOLS, 0)
    assert count("What a nice day. You are here") == none
    assert count("IDIOTS, all of it. trash! fine") == none | {"insult": 2}
    assert count("you are an idiot") == none | {"aimed insult": 1}
    assert count("this is not an idiot") == none | {"negated insult": 1}
    assert count("the man said it is trash") == none | {"reported": 1}
    assert count("he called it \"trash\" there") == none | {"reported": 1}
    assert count("you should kill it") == count("you kill") == none | {"threat": 1}
    assert count("kill the process") == none
    assert count("one bogga only") == none and count("bogga. and bogge") == none | {"slur": 2}
    assert count(None) == count("") == none


def test_composition_is_running_one_after_the_other():
    classes = ["word", *T.WORDS, "insult", "slur", "quote"]
    a, b = T.Transducer([0, 0]), T.Transducer([0, 1])
    a.arcs = {(0, "negation"): (1, "negation"), (1, "insult"): (0, "word")}
    b.arcs = {(0, "word"): (1, "quote"), (1, "insult"): (0, "threat")}
    both = T.compose(a, b, classes)
    text = ["insult", "negation", "insult", "word", "insult", "insult"]
    s = t = u = 0
    for c in text:
        s, middle = a.step(s, c)
        t, want = b.step(t, middle)
        u, got = both.step(u, c)
        assert got == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.score(docs, T.train(docs, labels)).join(labels, "doc_id").where(
        T.held_out(F.col("doc_id"))).collect()
    bad, good = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted for r in good) <= 0.02 * len(good)


def test_held_out_labels_are_not_read(spark, corpus, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    other = labels.withColumn("toxic", F.when(
        T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = T.train(corpus, labels), T.train(corpus, other)
    assert one.stems == two.stems and (one.weights == two.weights).all()


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (None, "idiot"), (3, "idiot " * 50_000), (3, "idiot"), (4, "é")]
    got = T.score(make_docs(rows), model()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.5) for r in got)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert T.train(make_docs(rows), labels).stems == {}
    assert T.score(make_docs([]), T.train(make_docs([]), labels)).count() == 0
