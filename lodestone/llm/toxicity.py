"""Toxicity by a lexicon that tolerates misspellings, and the context in which its terms stand.

A lexicon is learned from labelled documents: words that are more often in toxic ones, by at least LEAST_ODDS and with a
log-likelihood ratio so high that the share of false terms stays below FALSE_TERMS (Benjamini and Hochberg's bound over all
words tested). Its trie is intersected with Levenshtein automata, one edit for terms of 5 letters and two from 9 on; the
product is made deterministic as far as words need it, so that most words leave it after a few letters, and each worker looks
a word up once. A term allows edits only if the words near it speak for toxic documents as well, or no clean document has
any. Every hit is then judged in a window of words around it: inside quotation marks it is quoted speech, otherwise abuse. A
logistic model over the amounts of exact abuse, misspelled abuse and quotation gives the score; it is fitted with a prior, so
that kinds of hits which the labelled sample lacks keep a sensible weight.

Labels, language, source and doc_id are no inputs of a score. The lexicon and the model are fitted on at most `toxic_docs`
toxic and `clean_docs` other labelled documents, chosen by a hash of doc_id; all texts are read and scored whole.

Defined results: null and empty texts get the score of a text without hits; with no labels there is no lexicon and every
score is that of the prior; a document labelled both ways counts as toxic; null labels and ids are not learned from; of rows
that share a doc_id one is learned from; repeated rows each get their score; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, kept, pieces, table, texts_of, write_shared

TOXIC_DOCS, CLEAN_DOCS, MOST_TERMS = 4_000, 12_000, 400
#: A term is so many times as frequent in toxic documents, and a strong one so many times; the share of terms that may be
#: there by chance.
LEAST_ODDS, STRONG_ODDS, FALSE_TERMS = 10.0, 100.0, 0.05
#: Words near a term are so many times as frequent in toxic documents, or the term allows no edits.
NEAR_ODDS = 20.0
THRESHOLD, CONTEXT = 0.3, 6
_WORD = re.compile(r"\w+")
_OPEN, _CLOSE, _EITHER = "“«„‹", "”»›", '"'
#: Prior means and precisions of bias, strong abuse, weak abuse, misspelled strong abuse and quotation. Samples seldom hold
#: misspelled terms; the prior of these is then moved to NEAR times the weight that exact ones have learned.
PRIOR, NEAR = np.array([-3.0, 2.5, 1.0, 2.0, 0.2]), 0.9
PRECISION = np.array([0.1, 0.3, 0.3, 1.0, 1.0])


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """nearest(word): the edits to the nearest lexicon term within reach, or None. Terms in `strict` allow no edits."""

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset(), weak: frozenset[str] = frozenset()):
        self.terms, self.weak = frozenset(terms), weak
        edits_of = {t: 0 if t in strict else edits_allowed(t) for t in terms}
        self.children: list[dict[str, int]] = [{}]
        self.allowed = [0]  # the most edits that any term below a node allows
        self.ends = [-1]  # the edits that the term ending here allows
        self.term_at: dict[int, str] = {}
        for term in terms:
            node = 0
            for ch in term:
                self.allowed[node] = max(self.allowed[node], edits_of[term])
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.ends.append(-1)
                node = self.children[node][ch]
            self.allowed[node] = max(self.allowed[node], edits_of[term])
            self.ends[node] = edits_of[term]
            self.term_at[node] = term
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.accepts: list[tuple[int, bool] | None] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """The number of the state with these trie nodes and least edits, after leaving out term letters (deletions)."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            if edits > reached.get(node, 99):
                continue
            for to in self.children[node].values():
                if edits + 1 <= self.allowed[to] and edits + 1 < reached.get(to, 99):
                    reached[to] = edits + 1
                    todo.append((to, edits + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.accepts.append(min(((e, self.term_at[n] in self.weak) for n, e in key if e <= self.ends[n]), default=None))
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.allowed[node] and edits < reached.get(node, 99):
                reached[node] = edits

        for node, edits in self.states[state]:
            for letter, to in self.children[node].items():
                reach(to, edits + (letter != ch))
            reach(node, edits + 1)
        return self._state(reached) if reached else -1

    def hit(self, word: str) -> tuple[int, bool] | None:
        """The edits to the nearest term within reach, and whether only weak terms are so near; or None."""
        if word in self.terms:
            return 0, word in self.weak
        state = self._walk(word)
        return None if state < 0 else self.accepts[state]

    def nearest(self, word: str) -> int | None:
        found = self.hit(word)
        return found and found[0]

    def reached(self, word: str) -> list[str]:
        """All terms within reach of a word."""
        state = self._walk(word)
        return [] if state < 0 else [self.term_at[n] for n, e in self.states[state] if e <= self.ends[n]]

    def _walk(self, word: str) -> int:
        if len(self.steps) > 200_000:
            self.reset()
        state = self.start
        for ch in word:
            to = self.steps.get((state, ch))
            if to is None:
                to = self.steps[state, ch] = self._step(state, ch)
            if to < 0:
                return -1
            state = to
        return state


@dataclass
class Model:
    terms: list[str]
    strict: list[str]  # terms that other words come near to by nature; no edits for these
    weak: list[str]  # terms that clean documents use as well
    weights: list[float]


class Scorer:
    """A worker's view of a lexicon: known words cost a lookup."""

    def __init__(self, terms: list[str], strict: list[str], weak: list[str] = ()):
        self.trie, self.known = FuzzyTrie(terms, frozenset(strict), frozenset(weak)), {}

    def hits(self, words: list[str]) -> dict[int, tuple[int, bool]]:
        """Edits of the hits and whether they are weak, by word number."""
        known, out = self.known, {}
        if len(known) > 500_000:
            known.clear()
        for i, word in enumerate(words):
            try:
                found = known[word]
            except KeyError:
                found = self.trie.hit(word)
                if len(word) <= 64:
                    known[word] = found
            if found is not None:
                out[i] = found
        return out

    def features(self, text: str) -> list[float]:
        """log(1 + amount) of strong abuse, weak abuse (misspelled or not), misspelled strong abuse and quoted hits."""
        lower = text.lower()
        found = self.hits(_WORD.findall(lower))
        strong = faint = near = quoted = 0
        if found:
            spans = [m.span() for m in _WORD.finditer(lower)]
            for i, (edits, weak) in found.items():
                first, last = max(0, i - CONTEXT), min(len(spans), i + CONTEXT + 1)
                before, after = lower[spans[first][0] : spans[i][0]], lower[spans[i][1] : spans[last - 1][1]]
                open_ = sum(map(before.count, _OPEN)) > sum(map(before.count, _CLOSE)) or before.count(_EITHER) % 2 == 1
                closed = any(c in after for c in _CLOSE + _EITHER)
                if open_ and closed:
                    quoted += 1
                elif weak:
                    faint += 1
                elif edits:
                    near += 1
                else:
                    strong += 1
        return np.log1p([strong, faint, near, quoted]).tolist()


def _scorer(terms: list[str], strict: list[str], weak: list[str]) -> Scorer:
    return kept(("scorer", tuple(terms), tuple(strict), tuple(weak)), lambda: Scorer(terms, strict, weak))


def _sample(labels: DataFrame, toxic_docs: int, clean_docs: int) -> DataFrame:
    """(doc_id, toxic) of a bounded sample of the learnable labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    part = lambda label, n: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return part(1, toxic_docs).unionByName(part(0, clean_docs))


def lexicon(sample: DataFrame, most_terms: int = MOST_TERMS) -> dict[str, float]:
    """Words of sample (text, toxic) that mark toxic documents, strongest first, with their odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist()):
                (toxic if label else clean).update(set(_WORD.findall(text.lower())))
        words = list(toxic | clean)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], names=["word", "t", "c"])

    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t_all, c_all = size.get(1, 0), size.get(0, 0)
    if not t_all or not c_all:
        return {}
    words = sample.select("text", "toxic").mapInArrow(count, "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    share = (F.col("t") + F.col("c")) / (t_all + c_all)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (share * of))).otherwise(0.0)
    ratio = 2 * (part(F.col("t"), t_all) + part(F.col("c"), c_all))
    tested = words.where("t + c > 1")
    chosen = tested.withColumns({"ratio": ratio, "odds": _odds(F.col("t"), F.col("c"), t_all, c_all)}).where(F.col("odds") >= LEAST_ODDS)
    ranked = [(r.word, r.odds, math.erfc(math.sqrt(max(r.ratio, 0.0) / 2))) for r in chosen.orderBy(F.col("ratio").desc(), "word").limit(most_terms).collect()]
    tests = tested.count()
    last = max((k for k, (_, _, chance) in enumerate(ranked, 1) if chance <= FALSE_TERMS * k / tests), default=0)
    return {word: odds for word, odds, _ in ranked[:last]}


def _odds(t: Column | float, c: Column | float, t_all: int, c_all: int) -> Column | float:
    return (t + 0.5) / (t_all + 1) / ((c + 0.5) / (c_all + 1))


def crowded(sample: DataFrame, terms: list[str]) -> list[str]:
    """Terms near which an edit is no misspelling: clean documents have words that come near to them, and toxic ones do not
    have such words more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, count = FuzzyTrie(terms), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist()):
                count[label].update({term for word in set(_WORD.findall(text.lower())) - trie.terms for term in trie.reached(word)})
        for label in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(count[label]), pa.string()), pa.array([label] * len(count[label]), pa.int32()), pa.array(list(count[label].values()), pa.int64())], names=["term", "toxic", "n"])

    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    near: dict[str, list[int]] = {}
    for r in sample.mapInArrow(run, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n")).collect():
        near.setdefault(r.term, [0, 0])[r.toxic] = r.n
    return sorted(term for term, (c, t) in near.items() if c and _odds(t, c, size.get(1, 0), size.get(0, 0)) < NEAR_ODDS)


def fit(features: np.ndarray, labels: np.ndarray) -> list[float]:
    """Weights of a logistic model with a normal prior, by Newton's method."""
    x = np.column_stack([np.ones(len(features)), features]) if len(features) else np.zeros((0, len(PRIOR)))
    prior = w = PRIOR
    for _ in range(2):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - labels) + PRECISION * (w - prior)
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(PRECISION), grad)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        prior = PRIOR.copy()
        prior[3] = max(PRIOR[3], NEAR * w[1])
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, most_terms: int = MOST_TERMS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    bounded_batches(docs.sparkSession)
    # the sample has toxic_docs + clean_docs short rows at most, and one text for each
    chosen = docs.select("doc_id", "text").join(F.broadcast(_sample(labels, toxic_docs, clean_docs)), "doc_id")
    sample = write_shared(chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    found = lexicon(sample, most_terms)
    terms, weak = list(found), [t for t, odds in found.items() if odds < STRONG_ODDS]
    strict = crowded(sample, terms) if terms else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_scorer(terms, strict, weak).features(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    rows = sample.mapInArrow(run, "x array<double>, toxic int").collect() if terms else []
    return Model(terms, strict, weak, fit(np.array([r.x for r in rows]).reshape(-1, len(PRIOR) - 1), np.array([r.toxic for r in rows], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, w = _scorer(model.terms, model.strict, model.weak), np.array(model.weights)
        for whole in batches:
            for batch in pieces(whole):
                x = np.array([scorer.features(t) for t in texts_of(batch.column("text"))]).reshape(-1, len(w) - 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
