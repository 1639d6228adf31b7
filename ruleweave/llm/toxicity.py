"""Toxicity by a lexicon that Levenshtein automata search for misspelled terms, in context.

Learning.  Words and word beginnings that mark toxic texts are counted over a
bounded sample of labelled documents (MAX_EACH of either label, taken by a hash
of the id) and the strongest become the lexicon.  Features of the same sample
fit a logistic model, a few numbers for each document on the driver.

Matching.  The lexicon is a trie.  A word runs through the product of the trie
and a Levenshtein automaton of one edit, whose states are made as words need
them; so a word leaves the automaton at the letter that no term can explain.
Terms shorter than FUZZY_LEAST letters and beginnings match exactly only, and
words that ordinary texts of the sample use are no misspellings.

Context.  A term counts as quoted if a quotation mark opens within WINDOW words
before it and closes within WINDOW words after it, and as addressed if a word of
the window speaks to someone; the model weighs plain, quoted, addressed and
misspelled terms apart.

Null and empty texts have no terms; very long texts are read whole; ties and
repeated rows need no rule, as each row is scored alone; an empty table gives no
rows.  A column of the input named as the score gives way to it.  Without labels
of both kinds every score is the share of toxic ones (0 without labels).

The sample is written once and all choices from it are ordered, so two runs over
the same rows learn the same model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, fresh
from .hashing import shingle_sets

#: The bounds of the sample and of the lexicon.
MAX_EACH = 4000
MAX_TERMS = 1500
#: Ordinary words of the sample that lie one edit from a term, most common first.
MAX_ORDINARY = 50_000
LEAST_DOCS = 6
LEAST_ODDS = 3.0
FUZZY_LEAST = 5
PREFIXES = (4, 5, 6)
WINDOW = 6
#: States of the automaton and words looked up that a task keeps; forgetting them costs time only.
STATES, MEMO = 200_000, 400_000

TOKEN = re.compile(r"\w+|[\"“”„«»]")
MARKS = frozenset("\"“”„«»")
# Words that speak to someone.
ADDRESS = frozenset("you your youre u ya tu toi te vous vos votre du dich dir ihr euch dein deine usted ustedes ti tus vosotros".split())
ONE = " one"  # a beginning's mark in the lexicon: "term" + ONE


class Automaton:
    """Deterministic, made as needed: sets of (trie node, edits) as states."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[tuple[float, int]] = [(0.0, 0)]
        self.begin: list[float] = [0.0]
        for term, w in words.items():
            self.word[self._node(term)] = (w, len(term))
        for term, w in beginnings.items():
            self.begin[self._node(term)] = w
        self._reset()

    def _reset(self) -> None:
        self.index: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._close({(0, 0)}))

    def _node(self, term: str) -> int:
        at = 0
        for c in term:
            if c not in self.child[at]:
                self.child[at][c] = len(self.child)
                self.child.append({})
                self.word.append((0.0, 0))
                self.begin.append(0.0)
            at = self.child[at][c]
        return at

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the pairs that leave a letter of the term out."""
        more = {(n, 1) for at, e in pairs if e == 0 for n in self.child[at].values()}
        return frozenset(pairs | {(n, e) for n, e in more if (n, 0) not in pairs})

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.index:
            self.index[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
        return self.index[pairs]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for at, e in self.sets[state]:
            if c in self.child[at]:
                out.add((self.child[at][c], e))
            if e == 0:
                out.add((at, 1))
                out.update((n, 1) for n in self.child[at].values())
        to = self._state(self._close(out)) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[float, float]:
        """(weight of the exact term or beginning, weight of the term within one edit), 0 for none."""
        if len(self.sets) > STATES:
            self._reset()
        state, exact, at = self.start, 0.0, 0
        for c in word:
            at = self.child[at].get(c, -1) if at >= 0 else -1
            if at > 0:
                exact = max(exact, self.begin[at])
            to = self.moves[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return exact, 0.0
        near = 0.0
        for n, e in self.sets[state]:
            w, size = self.word[n]
            if e == 0:
                exact = max(exact, w)
            elif size >= FUZZY_LEAST:
                near = max(near, w)
        return exact, 0.0 if exact else near


class Scorer:
    """Features of a text."""

    NAMES = ("plain", "quoted", "addressed", "misspelled", "strongest", "density", "kinds")

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], ordinary: frozenset[str]):
        self.automaton, self.ordinary = Automaton(words, beginnings), ordinary
        self.memo: dict[str, tuple[float, float] | None] = {}

    def look(self, token: str) -> tuple[float, float] | None:
        if len(self.memo) > MEMO:
            self.memo.clear()
        exact, near = self.automaton.match(token)
        if near and token in self.ordinary:
            near = 0.0
        found = self.memo[token] = (exact, near) if exact or near else None
        return found

    def features(self, text: str | None) -> list[float]:
        tokens = TOKEN.findall(text.lower()) if text else []
        memo, look = self.memo, self.look
        hits = [(i, h) for i, t in enumerate(tokens) if (h := memo[t] if t in memo else look(t))]
        plain = quoted = addressed = near = top = 0.0
        kinds = set()
        for i, (e, n) in hits:
            kinds.add(tokens[i])
            top = max(top, e, n / 2)
            around = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            if any(t in MARKS for t in around[0]) and any(t in MARKS for t in around[1]):
                quoted += max(e, n)
                continue
            if n:
                near += n
            else:
                plain += e
            if any(t in ADDRESS for side in around for t in side):
                addressed += max(e, n)
        n = max(1, len(tokens))
        return [math.log1p(plain), math.log1p(quoted), math.log1p(addressed), math.log1p(near), top, math.log1p(100 * (plain + near) / n), math.log1p(len(kinds))]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, coefficients with the constant last), by Newton's method on standardised features."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    b = np.zeros(z.shape[1])
    penalty = ridge * np.diag([1.0] * x.shape[1] + [0.0]) * weight.sum() / 100
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + penalty @ b
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty + 1e-6 * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, b


def _terms(text: str) -> set[str]:
    words = {t for t in TOKEN.findall(text.lower()) if t not in MARKS and not t.isdigit()}
    return words | {w[:k] + ONE for w in words for k in PREFIXES if len(w) >= k}


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """(words, beginnings, ordinary words near them) from rows (_text, _y)."""

    def explode(batches):
        for batch in batches:
            terms, ys = [], []
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                got = sorted(_terms(t.as_py() or ""))
                terms += got
                ys += [y] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ys, pa.int32())], ["term", "y"])

    def kind(batches):
        for batch in batches:
            least = [int(x[0].view(np.int64)) if len(x) else 0 for x in shingle_sets(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["_text", "_y", "_least"])

    # Copies and near copies mostly share their least shingle: one of them, by a hash of its text, speaks for all.
    sample = sample.mapInArrow(kind, "_text string, _y int, _least long").groupBy("_least", "_y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    sample = cut(sample.select("_text", "_y"))
    size = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return {}, {}, frozenset()
    counts = sample.select("_text", "_y").mapInArrow(explode, "term string, y int").groupBy("term").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    odds = F.log((F.col("p") + 0.1) / (pos - F.col("p") + 0.1)) - F.log((F.col("n") + 0.1) / (neg - F.col("n") + 0.1))
    best = counts.where(F.col("p") >= LEAST_DOCS).withColumn("w", odds).where(F.col("w") >= LEAST_ODDS)
    rows = best.orderBy(F.desc("w"), F.desc("p"), "term").limit(MAX_TERMS).collect()
    begin = {r["term"].removesuffix(ONE): r["w"] for r in rows if r["term"].endswith(ONE)}
    # Of nested beginnings the shortest says it all; a word that one covers stays, as only words match misspelled.
    begin = {t: w for t, w in begin.items() if not any(t[:k] in begin for k in PREFIXES if k < len(t))}
    words = {r["term"]: r["w"] for r in rows if not r["term"].endswith(ONE)}
    probe = Automaton(words, begin)

    def near(batches):
        for batch in batches:
            keep = [bool(probe.match(t)[1]) for t in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    ordinary = counts.where((F.col("n") > 0) & ~F.endswith("term", F.lit(ONE))).select("term", "n").mapInArrow(near, "term string, n long")
    return words, begin, frozenset(r["term"] for r in ordinary.orderBy(F.desc("n"), "term").limit(MAX_ORDINARY).collect())


class Model:
    def __init__(self, words, begin, ordinary, mean, scale, coef, prior):
        self.words, self.begin, self.ordinary = words, begin, ordinary
        self.mean, self.scale, self.coef, self.prior = mean, scale, coef, prior

    def scores(self, scorer: Scorer, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([scorer.features(t) for t in texts]).reshape(-1, len(Scorer.NAMES))
        if self.coef is None:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale @ self.coef[:-1] + self.coef[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(key: str):
    """True for rows whose labels are not learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Of an id with several labels the greatest counts; of several texts each."""
    y = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & ~held_out("_id"))
    y = y.groupBy("_id").agg(F.max("_y").alias("_y"))
    size = {r["_y"]: r["n"] for r in y.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = {k: max(1, -(-size.get(k, 0) // MAX_EACH)) for k in (0, 1)}
    some = y.where(F.pmod(F.xxhash64("_id"), F.when(F.col("_y") == 1, share[1]).otherwise(share[0])) == 0)
    # About MAX_EACH rows of either label: a bounded broadcast.  Written once: later steps read the same rows.
    sample = cut(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(some), "_id").select("_text", "_y"))
    words, begin, ordinary = learn_lexicon(sample)
    total = sum(size.values())
    prior = size.get(1, 0) / total if total else 0.0
    if not words and not begin:
        return Model(words, begin, ordinary, None, None, None, prior)

    def measure(batches):
        scorer = Scorer(words, begin, ordinary)
        for batch in batches:
            x = [scorer.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    # A few numbers for each of the sample, in an order of their own: sums do not depend on the tasks.
    rows = sorted(sample.mapInArrow(measure, "x array<double>, y int").collect())
    x, t = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    weight = np.where(t == 1, share[1], share[0]).astype(float)
    return Model(words, begin, ordinary, *fit_logistic(x, t, weight), prior)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score."""
    kept = [f for f in docs.schema.fields if f.name != name]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    at = docs.columns.index(text)

    def run(batches):
        scorer = Scorer(model.words, model.begin, model.ordinary)
        for batch in batches:
            texts = batch.column(at)
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                s = model.scores(scorer, (t.as_py() for t in texts.slice(i, 512)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))


def reject(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more."""
    name = fresh(docs.columns, "_toxicity")
    return score(docs, model, text, name).where(F.col(name) < least).drop(name)
