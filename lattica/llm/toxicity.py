"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Terms are all words and word beginnings of the learned examples. A term weighs (1 + log times) x IDF x relevance, where relevance is
1 for most terms and grows with the surplus of evidence (root of the likelihood ratio) that ties a term to label 1; the norm of a
text takes in the words that no example has. Examples are laid out so that similar ones share a block, and the index keeps, for each
term and block, its postings and their greatest weight. A query bounds every block by these weights, scores a few blocks of greatest
bound, and then all those whose bound still reaches the k best so far, so the k nearest are exact. Their votes, weighted by
similarity and drawn to the prior where nothing is near, are calibrated on a part of the examples that a first index leaves out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, label_sample, small
from .langid import is_letter
from .textblock import BLOCK_CHARS, TextBlock, slices, span_hashes

#: Parameters: labelled rows of each class to learn from; neighbours; weight of the prior in a vote; examples in a block; blocks scored
#: first; a term that one example in SPARSE has is a full row; texts in one matrix product.
PER_LABEL, K, PRIOR_WEIGHT, BLOCK, FIRST_BLOCKS, SPARSE, AT_ONCE = 2000, 15, 0.05, 128, 3, 16, 64
#: Parameters: lengths of word beginnings; evidence from which relevance grows, and the power it grows with; share of examples to calibrate on.
PREFIXES, EVIDENCE, POWER, INNER_FOLDS = (4,), 2.0, 1.0, 4
FOLDS, FOLD, THRESHOLD = 4, 2, 0.3


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of all words and word beginnings, by text, then term."""
    block = TextBlock([t.lower() for t in texts])
    w0, w1 = block.words(~is_letter(block.codes))
    if not len(w0):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    doc = np.searchsorted(block.starts, w0, side="right") - 1
    whole, first, which = np.unique(span_hashes(block.codes, w0, w1), return_index=True, return_inverse=True)
    u0, u1 = w0[first], w1[first]
    docs, terms = [doc], [whole[which]]
    for k in PREFIXES:
        long = u1 - u0 > k
        begin = np.zeros(len(whole), np.uint64)
        begin[long] = span_hashes(block.codes, u0[long], u0[long] + k) * np.uint64(2 * k + 1) + np.uint64(k)
        at = long[which]
        docs.append(doc[at])
        terms.append(begin[which[at]])
    docs, terms = np.concatenate(docs), np.concatenate(terms)
    term, which = np.unique(terms, return_inverse=True)
    pair, times = np.unique(docs * len(term) + which, return_counts=True)
    return pair // len(term), term[pair % len(term)], times.astype(float)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for size[i] steps, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Index:
    """Unit vectors of examples as postings by term; a cell is a term's postings in one block, with their greatest weight.

    Terms that one example in SPARSE or more has are kept as full rows: a matrix product gives their part of all cosines.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        self.n, self.n_blocks = n, max(1, -(-n // BLOCK))
        df = np.bincount(term, minlength=n_terms)
        full = np.flatnonzero(df * SPARSE >= n)
        self.row = np.full(n_terms, -1, np.int32)  # of a term in the full rows
        self.row[full] = np.arange(len(full))
        dense = self.row[term] >= 0
        self.parts = (self.row[term[dense]], doc[dense].astype(np.int32), weight[dense], len(full))
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.lexsort((doc, term))
        self.doc, self.weight = doc[order].astype(np.int32), weight[order]
        cell = term[order].astype(np.int64) * self.n_blocks + self.doc // BLOCK
        at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.at = np.r_[at, len(cell)].astype(np.int32)
        self.block = (cell[at] % self.n_blocks).astype(np.int32)
        self.top = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.cells = np.searchsorted(cell[at] // self.n_blocks, np.arange(n_terms + 1)).astype(np.int32)
        self.rows = None

    def full_part(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Each query's cosines with all examples, as far as the full rows give them."""
        if self.rows is None:  # once in each worker
            row, doc, weight, n = self.parts
            self.rows = np.zeros((n, self.n))
            self.rows[row, doc] = weight
        q = np.zeros((len(queries), len(self.rows)))
        for i, (terms, weights) in enumerate(queries):
            r = self.row[terms]
            q[i, r[r >= 0]] = weights[r >= 0]
        return q @ self.rows

    def __getstate__(self):
        return self.__dict__ | {"rows": None}

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, sims: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest positive cosine, ties by number; sims is the query's row of full_part, which is used up."""
        sims = self.full_part([(terms, weights)])[0] if sims is None else sims
        rare = self.row[terms] < 0
        terms, weights = terms[rare], weights[rare]
        size = self.cells[terms + 1] - self.cells[terms]
        cell, w = _ranges(self.cells[terms], size), np.repeat(weights, size)
        block = self.block[cell]
        bound = np.bincount(block, w * self.top[cell], minlength=self.n_blocks)
        todo = bound > 0
        bound = bound + np.maximum.reduceat(sims, np.arange(0, self.n, BLOCK))
        now = np.zeros(self.n_blocks, bool)
        now[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        while True:
            now &= todo
            if now.any():
                mine = now[block]
                c = cell[mine]
                size = self.at[c + 1] - self.at[c]
                p = _ranges(self.at[c], size)
                sims += np.bincount(self.doc[p], np.repeat(w[mine], size) * self.weight[p], minlength=self.n)
                todo &= ~now
            worst = np.partition(sims, self.n - k)[self.n - k] if self.n > k else 0.0  # of sums so far, which only grow
            now = todo & (bound >= worst - 1e-9)
            if not now.any():
                break
        found = np.flatnonzero((sims > 0) & (sims >= worst - 1e-9))  # all that can be among the k
        best = found[np.lexsort((found, -sims[found].round(12)))[:k]]
        return best, sims[best]


class Vectors:
    """Term counts of texts, one after the other: at[i] to at[i + 1] are those of text i."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.at = np.cumsum([0, *(len(t) for t, _ in parts)])
        self.term = np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in parts)])
        self.times = np.concatenate([np.zeros(0), *(n for _, n in parts)])
        self.n = len(parts)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.at))

    def some(self, rows: np.ndarray) -> Vectors:
        return Vectors([(self.term[self.at[i] : self.at[i + 1]], self.times[self.at[i] : self.at[i + 1]]) for i in rows])


class Model:
    def __init__(self, prior: float):
        self.prior = self.base = prior
        self.index, self.labels, self.ids = None, np.zeros(0), []
        self.known, self.factor, self.rare = np.zeros(0, np.uint64), np.zeros(0), 1.0
        self.cost = np.zeros(0)  # of examples: puts the sample's class balance back to the prior
        self.slope, self.shift = 1.0, 0.0

    def learn(self, x: Vectors, y: np.ndarray, group: np.ndarray, ids: list) -> Model:
        """IDF and relevance of every term over texts that differ, and the index of all examples."""
        first = np.zeros(x.n, bool)
        first[np.unique(group, return_index=True)[1]] = True
        self.known, which = np.unique(x.term, return_inverse=True)
        m, n = len(self.known), int(first.sum())
        one = first[x.doc]
        df = np.bincount(which[one], minlength=m).astype(float)
        df1 = np.bincount(which[one], y[x.doc[one]], minlength=m)
        idf = np.log((1 + n) / (1 + df)) + 1
        self.rare = float(np.log((1 + n) / 2) + 1)  # also of words that no example has
        self.factor = idf * _relevance(df1, df, y[first].sum(), n)
        w = (1 + np.log(x.times)) * self.factor[which]
        norm = np.sqrt(np.bincount(x.doc, w * w, minlength=x.n))
        w /= np.maximum(norm[x.doc], 1e-12)
        place = _layout(x.doc, which, w, x.n, df)  # new number of each example
        order = np.argsort(place)
        self.index = Index(place[x.doc], which, w, x.n, m)
        self.labels, self.ids = y[order], [ids[i] for i in order]
        self.cost = np.where(self.labels == 1, self.prior / max(y.mean(), 1e-9), (1 - self.prior) / max(1 - y.mean(), 1e-9))
        self.place = place
        return self

    def query(self, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text, as numbers, and their weights in its unit vector."""
        if not len(term):
            return np.zeros(0, np.int64), np.zeros(0)
        i = np.minimum(np.searchsorted(self.known, term), len(self.known) - 1)
        hit = self.known[i] == term
        w = (1 + np.log(times)) * np.where(hit, self.factor[i], self.rare)
        return i[hit], w[hit] / max(float(np.sqrt(w @ w)), 1e-12)

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        w = sims * self.cost[ids]
        return float((w @ self.labels[ids] + PRIOR_WEIGHT * self.base) / (w.sum() + PRIOR_WEIGHT))

    def raw(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Vote, nearest examples and their cosines of each counted text."""
        for a in range(0, len(counts), AT_ONCE):
            queries = [self.query(*c) for c in counts[a : a + AT_ONCE]]
            for q, sims in zip(queries, self.index.full_part(queries), strict=True):
                ids, sims = self.index.nearest(*q, K, sims)
                yield (self.vote(ids, sims) if len(ids) else self.base), ids, sims

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[object, float, int]]]]:
        """Scores, and the nearest examples as (id, cosine, label)."""
        n = len(texts)
        if self.index is None:
            return np.full(n, self.prior), [[] for _ in range(n)]
        doc, term, times = term_counts(texts)
        at = np.searchsorted(doc, np.arange(n + 1))
        raw, evidence = np.full(n, self.base), [[] for _ in range(n)]
        some = np.flatnonzero(np.diff(at))
        for i, (raw[i], ids, sims) in zip(some, self.raw([(term[at[i] : at[i + 1]], times[at[i] : at[i + 1]]) for i in some]), strict=True):
            evidence[i] = [(self.ids[j], float(s), int(self.labels[j])) for j, s in zip(ids, sims, strict=True)]
        return self.calibrated(raw), evidence

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(raw) + self.shift, -30, 30)))


def _relevance(df1: np.ndarray, df: np.ndarray, n1: float, n: int) -> np.ndarray:
    """1 + (root of the likelihood ratio that a term is commoner under label 1, beyond EVIDENCE) ** POWER."""

    def part(seen, total, share):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(total * share, 1e-9)), 0.0)

    share = n1 / n
    g = 2 * (part(df1, df, share) + part(df - df1, df, 1 - share) + part(n1 - df1, n - df, share) + part((n - n1) - (df - df1), n - df, 1 - share))
    r = np.sqrt(np.maximum(g, 0)) * (df1 > df * share)
    return 1 + np.maximum(r - EVIDENCE, 0) ** POWER


def _layout(doc: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, df: np.ndarray) -> np.ndarray:
    """A number for each example so that neighbours share a block: halves by the widest principal direction of frequent terms, again and again."""
    top = np.sort(np.argsort(-df, kind="stable")[:400])
    i = np.minimum(np.searchsorted(top, term), len(top) - 1)
    hit = top[i] == term if len(top) else np.zeros(len(term), bool)
    x = np.zeros((n, max(len(top), 1)))
    x[doc[hit], i[hit]] = w[hit]
    x -= x.mean(0)
    values, axes = np.linalg.eigh(x.T @ x)
    x = (x @ axes[:, -8:]).round(9)
    place, stack, done = np.empty(n, np.int64), [np.arange(n)], 0
    while stack:
        rows = stack.pop()
        if len(rows) <= BLOCK:
            place[rows] = np.arange(done, done + len(rows))
            done += len(rows)
            continue
        rows = rows[np.argsort(x[rows, x[rows].var(0).argmax()], kind="stable")]
        half = max(BLOCK, len(rows) // 2 // BLOCK * BLOCK)
        stack += [rows[half:], rows[:half]]
    return place


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train_vectors(ids: list, x: Vectors, group: np.ndarray, labels: list[int], prior: float) -> Model:
    """A model of counted texts; group names texts that are equal, so that no copy is on both sides of the inner split."""
    model = Model(prior)
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return model
    inner = (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(INNER_FOLDS) == 0
    rest = np.flatnonzero(~inner)
    if inner.any() and len(rest) and y[rest].min() != y[rest].max():
        trial = Model(prior).learn(x.some(rest), y[rest], group[rest], [ids[i] for i in rest])
        out = np.flatnonzero(inner)
        raw = np.array([v for v, *_ in trial.raw([(x.term[x.at[i] : x.at[i + 1]], x.times[x.at[i] : x.at[i + 1]]) for i in out])])
        cost = np.where(y[out] == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        model.slope, model.shift = _platt(_logit(raw), y[out], cost)
    return model.learn(x, y, group, ids)


def _platt(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, float]:
    """Newton on the weighted log loss, drawn to slope 1 and shift 0, since examples may separate without overlap."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = cost * p * (1 - p)
        g = np.array([(cost * (p - y) * x).sum() + 5 * (a - 1), (cost * (p - y)).sum() + b])
        step = np.linalg.solve(np.array([[(h * x * x).sum() + 5, (h * x).sum()], [(h * x).sum(), h.sum() + 1]]), g)
        a, b = max(a - float(np.clip(step[0], -1, 1)), 0.05), b - float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-6:
            break
    return a, b


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, times) of each text."""
    out = []
    for a, b in slices(texts):
        doc, term, times = term_counts(texts[a:b])
        at = np.searchsorted(doc, np.arange(b - a + 1))
        out += [(term[at[i] : at[i + 1]], times[at[i] : at[i + 1]]) for i in range(b - a)]
    return out


def train(ids: list, texts: list[str], labels: list[int], prior: float) -> Model:
    copies: dict[str, int] = {}
    group = np.array([copies.setdefault(t, len(copies)) for t in texts], np.int64)
    return train_vectors(ids, Vectors(counted(texts)), group, labels, prior)


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parts = counted([t if isinstance(t, str) else "" for t in pdf["text"]])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "copy": pdf["copy"], "terms": [t.tobytes() for t, _ in parts], "times": [n.astype(np.uint32).tobytes() for _, n in parts]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Learns from the whole texts of a bounded sample: about per_label rows of each class, held-out rows never.

    The texts are counted by executors; the driver gets term counts. Repeated rows of one id and text count once.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, FOLD)).distinct()
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    picked = label_sample(known, "y", per_label)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(small(picked, 64), "doc_id").groupBy("doc_id", "y", F.xxhash64("text").alias("copy")).agg(F.min("text").alias("text"))
    got = rows.mapInPandas(_counter, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, copy long, terms binary, times binary").collect()
    got.sort(key=lambda r: (str(r.doc_id), r.copy))
    x = Vectors([(np.frombuffer(r.terms, np.uint64), np.frombuffer(r.times, np.uint32).astype(float)) for r in got])
    group = np.unique(np.array([r.copy for r in got], np.int64), return_inverse=True)[1]
    return train_vectors([r.doc_id for r in got], x, group, [r.y for r in got], counts.get(1, 0) / total if total else 0.5)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (probability of label 1) and evidence (nearest examples: doc_id, cosine, label) of each whole text.

    Null counts as empty; a text without a word that examples have gets the prior's score and no evidence. Neighbours that tie in
    cosine come by their number in the index. Repeated rows get equal scores; an empty table gives an empty one. A text longer than
    a block is one block of its own, at some 200 bytes of memory a character. Columns named score and evidence are replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<struct<doc_id long, cosine double, label int>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [t if isinstance(t, str) else "" for t in texts]
            scores, evidence = [], []
            for a, b in slices(values, BLOCK_CHARS):
                s, e = shared.value.score(values[a:b])
                scores += s.tolist()
                evidence += [[{"doc_id": d, "cosine": c, "label": y} for d, c, y in near] for near in e]
            yield pd.DataFrame({"score": pd.Series(scores, dtype="float64"), "evidence": pd.Series(evidence, dtype=object)})

    rest = [docs[f"`{c}`"] for c in docs.columns if c not in ("score", "evidence")]
    return docs.select(*rest, F.struct(score(docs["text"]).alias("s")).alias("score")).select(*[f"`{c}`" for c in docs.columns if c not in ("score", "evidence")], F.col("score.s.score").alias("score"), F.col("score.s.evidence").alias("evidence"))
