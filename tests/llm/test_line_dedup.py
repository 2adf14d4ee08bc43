import random
import re

import pytest

from fairledger.llm import line_dedup as L


def split(text):
    """(start, words) of each unit."""
    out, at = [], 0
    for piece in re.findall(r"(?s).+?(?:[.!?][ \t]+|\n+|\Z)", text or ""):
        out.append((at, re.findall(r"[^\x20\x09-\x0D]+", lower(piece))))
        at += len(piece)
    return out


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def brute(rows, unit=4, passage=50, shared=12):
    """Clean text of each row, by laying each row over all owners of its units at every shift."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    first, met = {}, {}
    for k in order:
        for start, words in split(rows[k][1]):
            if len(words) >= unit:
                own = first.setdefault(tuple(words), (k, start))
                if own != (k, start):
                    met.setdefault((k, own[0]), []).append((start, own[1], len(words)))
    gone = [set() for _ in rows]
    for (k, own), anchors in met.items():
        if sum(a[2] for a in anchors) < shared:
            continue
        x, y = ([(lower(m[0]), *m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", rows[r][1])] for r in (k, own))
        at = [{w[1]: n for n, w in enumerate(s)} for s in (x, y)]
        word_at = lambda s, a: min(n for p, n in s.items() if p >= a)
        for a, b, _ in anchors:
            i, j = word_at(at[0], a), word_at(at[1], b)
            lo, hi = 0, 0
            while i > lo and j > lo and x[i - lo - 1][0] == y[j - lo - 1][0]:
                lo += 1
            while i + hi < len(x) and j + hi < len(y) and x[i + hi][0] == y[j + hi][0]:
                hi += 1
            if lo + hi >= passage:
                gone[k] |= set(range(x[i - lo][1], x[i + hi - 1][2]))
    return sorted(((id, text and "".join(c for p, c in enumerate(text) if p not in gone[k]))
                   for k, (id, text) in enumerate(rows)), key=repr)


def result(docs, *options):
    return sorted(((r.doc_id, r.clean_text) for r in L.without_repeats(docs, *options).collect()), key=repr)


def sentence(low, high):
    return " ".join(random.choices("ä b c d e f g h i j k l m".split(), k=random.randint(low, high))) + "."


def test_clean_texts(spark, make_docs):
    random.seed(2)
    pool = [sentence(2, 14) for _ in range(30)]
    rows = []
    for i in range(40):
        parts = [random.choice(pool) if random.random() < 0.7 else sentence(2, 14) for _ in range(14)]
        rows.append((i, "".join(p + random.choice([" ", "\n", "\n\n", "  ", "\t"]) for p in parts)))
    rows += [(40, None), (41, ""), (42, "\n\n"), (43, rows[1][1]), (44, rows[2][1].upper()), (45, "word " * 20_000),
             (46, rows[3][1] + rows[3][1]), (None, rows[5][1] + " the end")]
    docs = make_docs(rows)
    for options in ((4, 50, 12), (1, 5, 1), (4, 20, 30)):
        want = brute(rows, *options)
        assert result(docs, *options) == want and want != sorted(rows, key=repr)


def passage(words, low, high):
    out = []
    while sum(len(s.split()) for s in out) < words:
        out.append(" ".join(f"w{random.randint(0, 9999)}" for _ in range(random.randint(low, high))) + ".")
    return " ".join(out)


@pytest.mark.parametrize("low,high", [(1, 10), (4, 9), (15, 22), (1, 3)])
@pytest.mark.parametrize("glue", ["", "x y z "])
def test_every_later_copy_of_a_passage_goes(spark, make_docs, low, high, glue):
    random.seed(low + high)
    rows, lost = [], []
    for k in range(40):
        p = passage(50, low, high)
        own = [f"a{k} {glue or '. '}{p} b{k} end", f"Start c{k}{glue and ' then'} {glue or '. '}{p} {glue}d{k}"]
        rows += [(2 * k, own[0]), (2 * k + 1, own[1])]
        lost.append(own[1].replace(p, ""))
    got = dict(result(make_docs(rows)))
    assert all(got[2 * k] == rows[2 * k][1] for k in range(40))
    hit = sum(len(got[2 * k + 1]) <= len(lost[k]) + 1 for k in range(40))
    # a passage none of whose sentences has four words holds no unit to find it by
    assert hit == 0 if high == 3 else hit == 40


def test_one_short_unit_finds_a_passage(spark, make_docs):
    """The sentences around it are glued to other text, so it is all that the rows share as a unit."""
    words = [f"w{k}" for k in range(50)]
    p = f"{' '.join(words[:25])}. Five words stand here alone. {' '.join(words[25:])}"
    rows = [(1, f"one start {p} one end"), (2, f"another begin {p} other end")]
    assert result(make_docs(rows)) == [rows[0], (2, "another begin  other end")]
    assert result(make_docs(rows), 4, 50, 12) == rows


def test_rows_of_one_id(spark, make_docs):
    random.seed(8)
    p = passage(60, 5, 9)
    unique = "Nothing of this occurs anywhere else, " + passage(60, 5, 9)
    rows = [(1, f"Lead. {p} Tail."), (2, f"Other. {p} More."), (2, unique), (3, p), (3, p), (None, p), (None, unique)]
    got = result(make_docs(rows))
    assert (2, unique) in got and (2, "Other.  More.") in got and (None, "") in got
    assert [t for i, t in got if i == 3] == ["", ""] and (1, rows[0][1]) in got
    once = result(make_docs([(7, p), (7, p), (None, unique), (None, unique)]))
    assert once == sorted([(7, p), (7, ""), (None, unique), (None, "")], key=repr)


def test_short_repeats_stay(spark, make_docs):
    line = "Licensed under the terms of some licence that every document names in full."
    rows = [(k, f"{line}\nText number{k} alone. {line}") for k in range(5)]
    assert result(make_docs(rows)) == rows


def test_empty_table(spark, make_docs):
    assert L.without_repeats(make_docs([])).count() == 0
    assert result(make_docs([(None, None)])) == [(None, None)]
