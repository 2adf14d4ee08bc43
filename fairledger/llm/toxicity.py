"""Toxicity by a weighted grammar of finite-state transducers over clauses.

A text is cut into clauses. A lexicon transducer turns words into classes: insult, threat, target,
negation, saying, quotation mark. Three more are composed with it: one turns an insult shortly after
a negation into a negated one, one an insult or threat that is said by somebody or stands in
quotation marks into a reported one, one an insult or threat near a target into an aimed one. A
clause counts under its heaviest symbol only; the score of a text is the logistic function of the
weighted numbers of its clauses.

Insults are word beginnings learned from labelled rows: those that best cover the toxic ones while
clean ones lack them, or, as slurs of less weight, do not hold them twice. A slur counts only where a text has
two. Weights are learned too, drawn towards the grammar's own where rows are few.
Both use at most `sample` labelled rows, those of the smallest hash of their ids; whole texts of all
documents are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.llm.common import in_arrow
from fairledger.plans.staging import stage

SAMPLE = 6000
LEXICON = 500
SHORTEST, LONGEST = 3, 10
#: Smallest log-likelihood ratio of a stem, and share of toxic texts among those that have it, or
#: for slurs have it twice.
EVIDENCE, PURITY, TWICE_PURITY = 10.0, 0.9, 0.8
#: Stems that should cover each toxic text, and the share of toxic texts a stem has to add.
COVER, GAIN = 3, 0.02
NEGATION_REACH, AIM_REACH = 3, 5

# Classes of function words in four languages.
WORDS = {
    "threat": "kill hurt destroy töten umbringen vernichten tuer détruire matar destruir",
    "target": "you your he she they du dich dein ihr sie tu toi vous ton votre tú te usted tu ellos",
    "negation": "not never no nicht nie kein keine pas jamais ne nunca jamás ni",
    "saying": "said says claimed wrote reported sagte sagt schrieb dit disait écrit dijo dice escribió",
}
QUOTES = "\"“”„«»"

SYMBOLS = ["insult", "aimed insult", "threat", "slur", "negated insult", "reported"]
#: The grammar's own weights: of no clause, and of the symbols in their order.
PRIOR = np.array([-3.0, 4.0, 5.0, 3.0, 3.0, 0.5, 0.5])
PRIOR_STRENGTH = 0.05

_TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES}]")
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")


@dataclass
class Transducer:
    """States 0, 1, ... and, for a state and a class read, the next state and the class written.

    Classes without an arc are copied, and lead to `others[state]`.
    """

    others: list[int]
    arcs: dict = field(default_factory=dict)

    def step(self, state: int, read: str) -> tuple[int, str]:
        return self.arcs.get((state, read), (self.others[state], read))


def compose(first: Transducer, second: Transducer, classes: list[str]) -> Transducer:
    """The transducer that feeds what `first` writes to `second`."""
    width = len(second.others)
    out = Transducer([])
    for p in range(len(first.others)):
        for q in range(width):
            out.others.append(first.others[p] * width + second.others[q])
            for c in classes:
                p2, middle = first.step(p, c)
                q2, written = second.step(q, middle)
                out.arcs[p * width + q, c] = p2 * width + q2, written
    return out


def grammar() -> Transducer:
    """Negation, reported speech and aim, composed."""
    classes = ["word", *WORDS, "insult", "slur", "quote"]
    n = NEGATION_REACH
    negation = Transducer([max(0, k - 1) for k in range(n + 1)])
    for k in range(n + 1):
        negation.arcs[k, "negation"] = n, "negation"
        if k:
            negation.arcs[k, "insult"] = k - 1, "negated insult"
    # 0 plain, 1 after a saying, 2 within quotation marks
    reported = Transducer([0, 1, 2])
    for k in range(3):
        reported.arcs[k, "saying"] = 2 if k == 2 else 1, "saying"
        reported.arcs[k, "quote"] = 0 if k == 2 else 2, "quote"
        if k:
            for c in ("insult", "slur", "threat", "negated insult"):
                reported.arcs[k, c] = k, "reported"
    a = AIM_REACH
    aim = Transducer([max(0, k - 1) for k in range(a + 1)])
    for k in range(a + 1):
        aim.arcs[k, "target"] = a, "target"
        aim.arcs[k, "threat"] = max(0, k - 1), "threat" if k else "word"
        if k:
            aim.arcs[k, "insult"] = k - 1, "aimed insult"
    inner = compose(negation, reported, classes)
    return compose(inner, aim, classes)


class Model:
    """Lexicon, grammar and weights."""

    def __init__(self, stems: dict[str, str], weights: np.ndarray = PRIOR):
        self.stems, self.weights = dict(stems), np.asarray(weights, float)
        self.lengths = sorted({len(s) for s in stems})
        self.fixed = {w: c for c, ws in WORDS.items() for w in ws.split()}
        self.grammar = grammar()

    def classes(self, words: set[str]) -> dict[str, str]:
        """The lexicon transducer for the words of a text; no stem begins another."""
        found = {w: self.fixed[w] for w in words & self.fixed.keys()}
        for w in words:
            for k in self.lengths:
                if w[:k] in self.stems:
                    found[w] = self.stems[w[:k]]
                    break
        return found

    def clauses(self, text: str | None) -> np.ndarray:
        """How many clauses have each symbol as their heaviest."""
        out = np.zeros(len(SYMBOLS))
        text = (text or "").lower()
        classes = self.classes(set(_WORD.findall(text)))
        if "slur" in classes.values() and sum(
                classes.get(w) == "slur" for w in _WORD.findall(text)) < 2:
            classes = {w: c for w, c in classes.items() if c != "slur"}
        if not {"insult", "slur", "threat"} & set(classes.values()):
            return out
        for clause in _CLAUSE.split(text):
            state, symbols = 0, set()
            for token in _TOKEN.findall(clause):
                state, written = self.grammar.step(
                    state, "quote" if token in QUOTES else classes.get(token, "word"))
                symbols.add(written)
            met = [i for i, s in enumerate(SYMBOLS) if s in symbols]
            if met:
                out[max(met, key=lambda i: self.weights[i + 1])] += 1
        return out

    def score(self, clauses: np.ndarray) -> np.ndarray:
        """Scores for rows of clause counts."""
        logit = self.weights[0] + np.log1p(clauses) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def choose_stems(
    stems: list[tuple[str, int, list[int], str]], least: float = 3, limit: int = LEXICON,
) -> dict[str, str]:
    """Greedy cover of the toxic texts by (stem, clean texts, toxic texts, class).

    The stem that adds most to texts not yet covered `COVER` times is next; of equal ones the purer,
    then the longer. One that adds fewer than `least` is left out, and so is one that begins with a
    chosen one, or the other way round.
    """
    left, out = {}, {}
    for _, _, docs, _ in stems:
        left.update(dict.fromkeys(docs, COVER))
    open_ = list(stems)
    while open_ and len(out) < limit:
        gains = [sum(left[d] > 0 for d in docs) for _, _, docs, _ in open_]
        best = max(range(len(open_)), key=lambda i: (
            gains[i], len(open_[i][2]) / (len(open_[i][2]) + open_[i][1]), len(open_[i][0]),
            open_[i][0]))
        if gains[best] < least:
            break
        stem, _, docs, kind = open_[best]
        out[stem] = kind
        for d in docs:
            left[d] -= 1
        open_ = [s for i, s in enumerate(open_)
                 if gains[i] >= least and not s[0].startswith(stem) and not stem.startswith(s[0])]
    return out


def fit_weights(clauses: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression drawn towards the grammar's own weights, by Newton's method."""
    x = np.column_stack([np.ones(len(clauses)), np.log1p(clauses)])
    w = PRIOR.copy()
    pull = np.full(len(w), PRIOR_STRENGTH)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - toxic) + pull * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(curve, slope)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def _number(id):
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary"))


def held_out(id):
    """Rows whose labels are never learned from."""
    return F.pmod(_number(id), F.lit(5)) == 0


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id",
    text: str = "text", label: str = "toxic",
) -> Model:
    """Lexicon and weights from labelled rows that are not held out; without any, the grammar's own.

    Of several labels for an id the largest counts; null labels and ids count as no label.
    """
    chosen = stage(
        labels.select(F.col(id).alias("doc_id"), F.col(label).cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = stage(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(chosen), "doc_id").dropDuplicates(["text", "toxic"]))  # `sample` rows at most
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = counts.get(1, 0), sum(n for k, n in counts.items() if k != 1)
    if not bad or not good:
        return Model({})

    def stems(batch):
        got = []
        for doc, body, toxic in zip(
            batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["toxic"].to_pylist()
        ):
            own = Counter()
            for word in _WORD.findall((body or "").lower()):
                own.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
            got += [(s, doc, toxic == 1, n > 1) for s, n in own.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*got) if got else [[]] * 4, kinds)],
            names=["stem", "doc", "bad", "twice"])

    base = bad / (bad + good)
    found = in_arrow(
        rows.select("doc_id", "text", "toxic"), "stem string, doc long, bad boolean, twice boolean",
        stems)

    def kind(name, which, purity):
        t, c = F.count_if(which & F.col("bad")), F.count_if(which & ~F.col("bad"))
        share = F.try_divide(t, t + c)
        evidence = F.when(t > 0, t * F.log(share / base)).otherwise(0.0) + F.when(
            c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0)
        return F.when((share >= purity) & (evidence >= EVIDENCE), F.struct(
            c.alias("clean"), F.collect_list(F.when(which & F.col("bad"), F.col("doc"))).alias("docs"),
            F.lit(name).alias("kind")))

    candidates = found.groupBy("stem").agg(F.coalesce(
        kind("insult", F.lit(True), PURITY), kind("slur", F.col("twice"), TWICE_PURITY)
    ).alias("s")).where("s is not null").orderBy(
        F.size("s.docs").desc(), "stem").limit(20 * LEXICON)
    model = Model(choose_stems(
        [(r.stem, r.s.clean, r.s.docs, r.s.kind) for r in candidates.collect()],
        max(3, GAIN * bad)))

    def counted(batch):
        got = [model.clauses(body) for body in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(got, pa.list_(pa.float64())), batch["toxic"]], names=["clauses", "toxic"])

    seen = in_arrow(rows.select("text", "toxic"), "clauses array<double>, toxic int", counted).collect()
    model.weights = fit_weights(
        np.array([r.clauses for r in seen]), np.array([float(r.toxic == 1) for r in seen]))
    return model


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, score, predicted, clauses.

    Null and empty texts have no clause and the score of none; null ids and repeated rows are scored
    as any other, an empty table gives none; other columns are not read.
    """
    def scored(batch):
        clauses = np.array(
            [model.clauses(t) for t in batch["text"].to_pylist()]).reshape(-1, len(SYMBOLS))
        scores = model.score(clauses)
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
            pa.array(clauses.sum(axis=1).astype(np.int64)),
        ], names=["doc_id", "score", "predicted", "clauses"])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_arrow(rows, "doc_id long, score double, predicted int, clauses long", scored)


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, each by its own text."""
    at = docs.columns.index(text)

    def kept(batch):
        clauses = np.array(
            [model.clauses(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(SYMBOLS))
        yield batch.filter(pa.array(model.score(clauses) < 0.5))

    return in_arrow(docs, docs.schema, kept)
