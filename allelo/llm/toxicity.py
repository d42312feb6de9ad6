"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes, calibration.

Examples are the different texts of a bounded sample of labelled documents; every word of every example is a term. Vectors
are TF-IDF of unit length: 1 + log of the count, times the inverse document frequency, times the word's relevance, which is
near 1 for words that clearly prefer one class and near LEAST_RELEVANCE, never zero, for all others. The index holds each term's
postings by block of BLOCK examples with the greatest weight in the block; words of many examples, which every block has, are
dense rows instead, and give part of each cosine. A query reads the postings of those blocks only whose bound (the best
part in the block and the greatest weights of the query's other words there) reaches the K-th best part, so the K nearest are
exact. They vote with a power of their
cosine (the distance weight) times their class's share among all labelled rows over its share of the sample; votes are
calibrated by isotonic regression of the examples' own leave-one-out votes, in which equal texts are one example. A document
without a word of any example gets the share of label 1.

Defined cases: null and empty texts have no words; without labels of both kinds every score is the share of label 1;
repeated rows are scored alike; very long texts are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learn_sample, map_slices
from .decontaminate import fold_words

K, BLOCK = 15, 32
#: Share of the examples from which on a word's postings are a dense row; queries at once.
DENSE, TOGETHER = 1 / 16, 256
#: Chi-squared statistic of a word at which its relevance is a half; the least relevance; the power of the cosine.
HALF_RELEVANCE, LEAST_RELEVANCE, POWER = 30.0, 0.1, 2.0
#: Bounds of the sample of examples: labelled documents, and bytes of one (of longer ones a piece at a hashed place).
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 65536


def _spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [start, stop) one after the other, and the range of each."""
    n = stop - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which], which


class Neighbours:
    def __init__(self, sample: list[tuple[int, str]], share: float, k: int = K):
        self.k, self.share = k, share
        labels: dict[str, list[int]] = {}
        for y, t in sample:
            labels.setdefault(t, []).append(y)
        y = np.array([np.mean(v) for v in labels.values()])
        bags = [Counter(fold_words(t)) for t in labels]
        df = [Counter(), Counter()]
        for bag, label in zip(bags, y, strict=True):
            df[int(label >= 0.5)].update(bag.keys())
        n1 = int((y >= 0.5).sum())
        n0 = len(y) - n1
        terms = sorted(df[0] | df[1])
        self.terms = {w: i for i, w in enumerate(terms)}
        d0, d1 = (np.array([d[w] for w in terms], np.float64) for d in df)
        # chi-squared of the word and the class
        chi2 = (n1 + n0) * (d1 * (n0 - d0) - d0 * (n1 - d1)) ** 2 / np.maximum((d1 + d0) * (n1 + n0 - d1 - d0) * n1 * n0, 1)
        relevance = LEAST_RELEVANCE + (1 - LEAST_RELEVANCE) * chi2**2 / (chi2**2 + HALF_RELEVANCE**2)
        self.idf = (np.log((1 + n0 + n1) / (1 + d0 + d1)) + 0.1) * relevance
        vectors = [self.vector(b) for b in bags]
        # similar examples side by side make tight bounds: by class, then by their heaviest term
        lead = [int(v[0][v[1].argmax()]) if v is not None else -1 for v in vectors]
        order = np.lexsort((lead, y))
        self.y = y[order]
        vectors = [vectors[i] for i in order]
        share1, share0 = max(self.y.mean(), 1e-9), max(1 - self.y.mean(), 1e-9)
        self.weight = np.where(self.y >= 0.5, share / share1, (1 - share) / share0)
        self._index(vectors, d0 + d1)
        near = self.nearest(vectors, leave=np.arange(len(vectors)))
        self.steps = _isotonic([(self.vote(*near[d]), self.y[d], self.weight[d]) for d, v in enumerate(vectors) if v is not None])

    def _index(self, vectors: list, df: np.ndarray) -> None:
        """Dense rows of frequent terms. Postings of the others by term, block and example; of every (term, block) its
        postings and its greatest weight."""
        frequent = np.flatnonzero(df >= max(DENSE * len(vectors), 2))
        self.row = np.full(len(df), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), len(vectors)))
        some = [(v[0], v[1], np.full(len(v[0]), d)) for d, v in enumerate(vectors) if v is not None]
        term, weight, doc = (np.concatenate(c) for c in zip(*some, strict=True))
        often = self.row[term] >= 0
        self.dense[self.row[term[often]], doc[often]] = weight[often]
        o = np.lexsort((doc, term))
        o = o[~often[o]]
        term, self.doc, self.w = term[o], doc[o].astype(np.int32), weight[o]
        self.blocks = -(-len(vectors) // BLOCK)
        key = term * self.blocks + self.doc // BLOCK
        first = np.flatnonzero(np.diff(key, prepend=-1))
        self.cell = np.append(first, len(key))  # postings of a (term, block)
        self.cell_block = (key[first] % self.blocks).astype(np.int32)
        self.cell_top = np.maximum.reduceat(self.w, first) if len(first) else np.zeros(0)
        self.of_term = np.searchsorted(key[first] // self.blocks, np.arange(len(df) + 1))

    def vector(self, bag: Counter):
        """(terms, weights) of unit length, or None without any term."""
        get = self.terms.get
        found = [(i, n) for w, n in bag.items() if (i := get(w)) is not None]
        if not found:
            return None
        t, n = np.array(found).T
        o = np.argsort(t)
        t, n = t[o], n[o]
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / np.sqrt(w @ w)

    def nearest(self, vectors: list, leave=None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each vector the K examples of greatest cosine (ties by number) among those that share a term, with their
        cosines, without the example ``leave``."""
        out: list = []
        for i in range(0, len(vectors), TOGETHER):
            some = vectors[i : i + TOGETHER]
            q = np.zeros((len(some), len(self.dense)))
            for j, v in enumerate(some):
                if v is not None:
                    r = self.row[v[0]]
                    q[j, r[r >= 0]] = v[1][r >= 0]
            part = q @ self.dense
            if leave is not None:
                part[np.arange(len(some)), leave[i : i + TOGETHER]] = -2.0  # less than any sum
            out += [self._nearest(v, p) if v is not None else (np.zeros(0, np.int64), np.zeros(0)) for v, p in zip(some, part, strict=True)]
        return out

    def _nearest(self, v, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = min(self.k, len(part))
        terms, weights = v
        cell, which = _spans(self.of_term[terms], self.of_term[terms + 1])
        if len(cell):
            w, block = weights[which], self.cell_block[cell]
            bounds = np.bincount(block, w * self.cell_top[cell], self.blocks) + np.maximum.reduceat(part, np.arange(0, len(part), BLOCK))
            open_ = bounds >= np.partition(part, len(part) - k)[len(part) - k] - 1e-9
            now = open_[block]
            at, of = _spans(self.cell[cell[now]], self.cell[cell[now] + 1])
            part = part + np.bincount(self.doc[at], self.w[at] * w[now][of], len(part))
        near = np.flatnonzero(part >= max(np.partition(part, len(part) - k)[len(part) - k] - 1e-9, 1e-9))
        cos = np.round(part[near], 9)  # sums in another order may differ by less
        o = np.lexsort((near, -cos))[: self.k]
        return near[o], cos[o]

    def vote(self, who: np.ndarray, cos: np.ndarray) -> float:
        w = cos**POWER * self.weight[who]
        return float((w @ self.y[who] + 1e-3 * self.share) / (w.sum() + 1e-3))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Calibrated score of each text, and its nearest examples as evidence."""
        vectors = [self.vector(Counter(fold_words(t))) for t in texts]
        found = self.nearest(vectors)
        return [(self.share, []) if v is None else (float(np.interp(self.vote(*n), *self.steps)), n[0].tolist()) for v, n in zip(vectors, found, strict=True)]


def _isotonic(votes: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators on (vote, label, weight); one prior row at either end keeps it within 0 and 1."""
    rows = sorted([(0.0, 0.0, 0.5), *votes, (1.0, 1.0, 0.5)])
    pools: list[list[float]] = []
    for x, y, w in rows:
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES):
    sample, share = learn_sample(docs, labels, "toxic", modulus, held, rows, max_bytes)
    return Neighbours(sample, share) if len({y for y, _ in sample}) == 2 else share


def toxicity(docs: DataFrame, labels: DataFrame, model=None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and how many labelled examples are its evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels) if model is None else model)  # bounded by the sample
    d = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        model = sent.value
        got = model.score(texts) if isinstance(model, Neighbours) else [(float(model), [])] * len(texts)
        score = np.array([s for s, _ in got])
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(e) for _, e in got], pa.int32())],
            names=["doc_id", "held_out", "score", "predicted", "n_evidence"],
        )

    return map_slices(d, run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_evidence int")
