import random

from fairledger.llm import decontam


def brute(rows, items, width=5, num=4, den=5):
    def grams(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    out = []
    for id, text in rows:
        for item, body in items:
            words = decontam.words(body)
            k = min(width, len(words))
            if not k:
                continue
            own = grams(words, k)
            both = len(own & grams(decontam.words(text), k))
            if both * den >= len(own) * num:
                out.append((id, item, len(own), both, both / len(own)))
    return sorted(out, key=repr)


def test_items_in_documents(spark, make_docs):
    random.seed(1)
    word = lambda: f"w{random.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(random.choice([1, 2, 4, 5, 6, 9, 20, 55])))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "?! ..."), (43, "Über, den FLUSS und weiter"), (None, "a b c d e f")]
    items += [items[3]]
    rows = []
    for i in range(60):
        text = [word() for _ in range(random.choice([0, 3, 30, 2000]))]
        for _ in range(3):
            leak = (random.choice(items)[1] or "").split()
            for _ in range(random.choice([0, 0, 1, 2])):
                if leak:
                    leak[random.randrange(len(leak))] = "changed"
            at = random.randint(0, len(text))
            text[at:at] = leak
        rows.append((i, " ".join(text).upper() if i % 7 == 0 else " ".join(text)))
    rows += [(60, None), (61, ""), (None, "a, b! c d e f"), (62, "ÜBER den Fluss; und weiter")] + [rows[0]]
    table = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "text")
    want = brute(rows, items)
    assert len(want) > 60
    for block in (decontam.BLOCK_SHINGLES, 300):
        got = decontam.contained(make_docs(rows), table, block_shingles=block).collect()
        assert sorted(map(tuple, got), key=repr) == want


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontam.contained(make_docs([(1, "a b c d e")]), none).count() == 0
    assert decontam.contained(make_docs([]), some).count() == 0
    assert decontam.contained(make_docs([(1, "A b. c d e")]), some).count() == 1


def test_sketch_covers_what_may_be_missed():
    for n in range(1, 300):
        k = decontam.sketch_size(n, 4, 5)
        assert 1 <= k <= n and k > n - -(-n * 4 // 5)
