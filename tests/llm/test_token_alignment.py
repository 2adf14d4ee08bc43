import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fairledger.llm import token_alignment as T

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """Tokens of a text, (id, bytes) on both sides, straight from the two libraries."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = T.byte_letters()

    def tokens(text):
        left = [(i, bytes(letters[c] for c in a.id_to_token(i)))
                for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                  else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return left, right

    return tokens


def spans(tokens):
    at, out = 0, []
    for id, body in tokens:
        out.append((id, at, at + len(body)))
        at += len(body)
    return out


def brute(rows, plain):
    linked, found = Counter(), []
    for id, text in rows:
        left, right = plain(text) if text else ([], [])
        body = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in left) != body or b"".join(t for _, t in right) != body:
            found.append((id, None, None, None, []))
            continue
        x, y = spans(left), spans(right)
        links = [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
        common = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, lo = [], 0
        for hi in common:
            groups.append([[i for i, _, e in side if lo < e <= hi] for side in (x, y)])
            lo = hi
        linked.update(set(links))
        found.append((id, x, y, groups, links))
    best = {}
    for (p, _), n in linked.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for id, x, y, groups, links in found:
        if x is None:
            out.append((id, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((id, len(x), len(y), len(groups), len(links), sum(linked[p] == best[p[0]] for p in links),
                    sum(linked[p] for p in links), hashlib.sha256(text.encode()).hexdigest(),
                    sum(len(p) * len(q) for p, q in groups)))
    return sorted(out, key=repr)


def result(docs, **more):
    got = T.scored(docs, T.ByteBpe(A), T.PieceBpe(B), **more).collect()
    return sorted(map(tuple, got), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "   two  blanks\t\n\n x "), (5, "naïve café – “quoted” 日本語 \U0001f600"),
    (6, "<|endoftext|> <s> </s> <unk> <0x41>"), (7, "lower▁line"), (8, "nul\0 and \x1c\x1d \xa0 ﬁ é ½"),
    (None, "a row without id"), (9, "twice"), (9, "twice"), (9, "twice, other text"), (10, "'s 'll don't 12345 !!!???"),
    (11, " leading"), (12, "　wide line"),
]


def test_odd_rows(spark, make_docs, plain):
    assert result(make_docs(ODD)) == brute(ODD, plain)
    assert result(make_docs([])) == []
    assert result(make_docs([(None, None)])) == [(None, 0, 0, 0, 0, 0, 0, "", 0)]


@pytest.mark.parametrize("block,rows", [(1 << 20, 1_000_000), (40, 1_000_000), (200, 0)])
def test_blocks_and_broadcasts_change_nothing(spark, corpus, make_docs, plain, monkeypatch, block, rows):
    monkeypatch.setattr(T, "BLOCK", block)
    texts = [(r[0], r[1][:700]) for r in corpus.orderBy("doc_id").limit(40).collect()] + ODD
    assert result(make_docs(texts), broadcast_rows=rows) == brute(texts, plain)


def test_long_text(spark, make_docs, plain):
    random.seed(3)
    text = " ".join(random.choice(["word", "wörd", "  ", "…", "12", "x" * 50]) for _ in range(300_000))
    row = result(make_docs([(1, text)]))[0]
    left, right = plain(text)
    ends = [set(e for _, _, e in spans(t)) for t in (left, right)]
    assert row[1:4] == (len(left), len(right), len(ends[0] & ends[1]))
    assert row[4] == len(left) + len(right) - row[3]  # each further link ends one token


def test_token_links(spark, make_docs, plain):
    got = T.token_links(make_docs(ODD), T.ByteBpe(A), T.PieceBpe(B)).collect()
    want = []
    for id, text in ODD:
        left, right = plain(text) if text else ([], [])
        body = (" " + (text or "")).encode()
        if b"".join(t for _, t in left) == b"".join(t for _, t in right) == body:
            want += [(id, i, j, p[0], q[0], min(p[2], q[2]) - max(p[1], q[1]))
                     for i, p in enumerate(spans(left)) for j, q in enumerate(spans(right))
                     if p[1] < q[2] and q[1] < p[2]]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_products_are_those_of_dense_matrices():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2, (7, 9)), rng.integers(0, 2, (9, 5))

    def rows(m):
        return T.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])

    r, c, v = rows(x).times(rows(y))
    dense = np.zeros((7, 5), int)
    dense[r, c] = v
    assert (dense == x @ y).all() and (v > 0).all()
    assert rows(x).size_of_product(rows(y)) == (x @ y).sum()
    t = rows(x).transposed()
    assert (t.start == rows(x.T).start).all() and (t.columns == rows(x.T).columns).all()


def test_groups_as_products():
    ends_a, ends_b = np.array([2, 3, 6, 7]), np.array([1, 3, 7])
    run = T.Aligned(np.array([5, 6, 7, 8]), np.array([1, 2, 3]), ends_a, ends_b)
    a, b = run.group_rows()
    row, column, _ = a.times(b.transposed())
    assert list(zip(row, column)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 2)]
    assert a.size_of_product(b.transposed()) == 6


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        T.ByteBpe("/opt/tokenizers/word_bpe_49k.json")
