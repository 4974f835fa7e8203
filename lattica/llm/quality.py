"""Quality: attention-based multiple-instance learning over the passages of a text.

Every passage (a line, cut every PASSAGE characters) is encoded from character classes, class changes, word lengths and word
repeats; a gate learned from document labels weights the passages; the weighted representation gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, label_sample, small
from .textblock import TextBlock, by_block, slices, span_hashes

#: Parameters: passage length; labelled rows of each class to learn from, and characters of a row (pieces of longer ones); sizes and steps of training.
PASSAGE, PER_LABEL, SAMPLE_CHARS = 400, 2000, 20_000
HIDDEN, GATE, STEPS, RATE, DECAY, SEED = 24, 12, 200, 0.02, 1e-4, 7
FOLDS, FOLD, THRESHOLD = 5, 0, 0.3

_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]
_N_CLASS = 6 + len(_PUNCT) + 3


def _class_table() -> np.ndarray:
    t = np.full(0x10000, _N_CLASS - 1, np.int64)
    for c in range(0x300):
        ch = chr(c)
        if ch == " ":
            t[c] = 0
        elif ch == "\n":
            t[c] = 1
        elif c < 33 or ch.isspace():
            t[c] = 2
        elif c < 128:
            t[c] = 3 if ch.islower() else 4 if ch.isupper() else 5 if ch.isdigit() else 6 + _PUNCT.index(c) if c in _PUNCT else 2
        else:
            t[c] = _N_CLASS - 3 if ch.isalpha() else _N_CLASS - 2
    return t


CLASS = _class_table()
#: Coarse kinds for class changes: space, letter, digit, stop or comma, other mark.
_COARSE = np.array([0, 0, 0, 1, 1, 2, *[3 if chr(c) in ".,;:!?'\"()-" else 4 for c in _PUNCT], 1, 4, 1])
_LAGS = (1, 2, 3, 4, 6, 8)
N_FEATURES = _N_CLASS + 25 + len(_LAGS) + 7


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage and the index of its text, in order; an empty text has one passage without characters."""
    block = TextBlock(texts)
    codes = block.codes
    cls = CLASS[np.minimum(codes, 0xFFFF)]
    lines = np.unique(np.r_[block.starts[:-1], np.flatnonzero(cls == 1) + 1])
    lines = lines[lines < len(codes)] if len(codes) else lines[:0]
    size = np.diff(np.r_[lines, len(codes)])
    cuts = -(-size // PASSAGE)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = np.repeat(lines, cuts) + nth * PASSAGE
    length = np.minimum(np.repeat(size, cuts) - nth * PASSAGE, PASSAGE)
    doc = np.searchsorted(block.starts, start, side="right") - 1
    pid = np.repeat(np.arange(len(start)), length)
    n = len(start)
    x = np.zeros((n, N_FEATURES), np.float32)
    if n:
        x[:, :_N_CLASS] = np.bincount(pid * _N_CLASS + cls, minlength=n * _N_CLASS).reshape(n, _N_CLASS) / length[:, None]
        kind = _COARSE[cls]
        change = pid[1:] * 25 + kind[:-1] * 5 + kind[1:]
        same = pid[1:] == pid[:-1]
        x[:, _N_CLASS : _N_CLASS + 25] = np.bincount(change[same], minlength=n * 25).reshape(n, 25) / length[:, None]
        w0, w1 = block.words(kind == 0)
        if len(w0):
            wp, wh = pid[w0], span_hashes(codes, w0, w1)
            words = np.maximum(np.bincount(wp, minlength=n), 1)
            at = _N_CLASS + 25
            for k, lag in enumerate(_LAGS):
                if len(w0) > lag:
                    again = (wh[lag:] == wh[:-lag]) & (doc[wp[lag:]] == doc[wp[:-lag]])
                    x[:, at + k] = np.bincount(wp[lag:][again], minlength=n) / words
            at += len(_LAGS)
            size_w = w1 - w0
            mean = np.bincount(wp, size_w, minlength=n) / words
            x[:, at] = mean / 8
            x[:, at + 1] = np.sqrt(np.maximum(np.bincount(wp, size_w.astype(float) ** 2, minlength=n) / words - mean**2, 0)) / 8
            x[:, at + 2] = np.bincount(wp[kind[w1 - 1] == 4], minlength=n) / words
            x[:, at + 3] = np.bincount(wp[kind[w0] != 1], minlength=n) / words
            x[:, at + 4] = np.log1p(words) / 5
            x[:, at + 5] = np.log1p(length) / 6
            x[:, at + 6] = np.bincount(wp[size_w > 25], minlength=n) / words
    blank = np.setdiff1d(np.arange(block.n), doc)
    if len(blank):
        doc, x = np.r_[doc, blank], np.vstack([x, np.zeros((len(blank), N_FEATURES), np.float32)])
        order = np.argsort(doc, kind="stable")
        doc, x = doc[order], x[order]
    return x, doc


class Model:
    """Parameters as arrays; prior alone (no arrays) if the labels have fewer than two classes."""

    def __init__(self, prior: float):
        self.prior, self.p = prior, None

    def _forward(self, x, doc, n):
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        first = np.searchsorted(doc, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        weight = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(weight[:, None] * h, first)
        return h, t, s, weight, first, z, z @ p["c"] + p["d"]

    def score(self, x, doc, n) -> np.ndarray:
        if self.p is None:
            return np.full(n, self.prior)
        return 1 / (1 + np.exp(-np.clip(self._forward((x - self.mean) / self.std, doc, n)[-1] + self.shift, -30, 30)))

    def score_texts(self, texts: list[str]) -> np.ndarray:
        x, doc = passages(texts)
        return self.score(x, doc, len(texts))


def gradients(model: Model, x, doc, n: int, y, cost) -> dict[str, np.ndarray]:
    """Of the weighted log loss of n documents by the parameters, through the gate's softmax."""
    p = model.p
    h, t, s, weight, first, z, out = model._forward(x, doc, n)
    d_out = ((1 / (1 + np.exp(-out)) - y) * cost).astype(x.dtype)
    g = {"c": z.T @ d_out, "d": d_out.sum()}
    d_z = d_out[:, None] * p["c"]
    d_h = weight[:, None] * d_z[doc]
    d_weight = (h * d_z[doc]).sum(1)
    d_e = weight * (d_weight - np.add.reduceat(weight * d_weight, first)[doc])
    g["a"] = (t * s).T @ d_e
    d_ts = d_e[:, None] * p["a"]
    d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
    g["v"], g["u"] = h.T @ d_t, h.T @ d_s
    d_h = (d_h + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h * h)
    g["w"], g["b"] = x.T @ d_h, d_h.sum(0)
    return g


def train(texts: list[str], labels: list[int], prior: float) -> Model:
    """Full-batch Adam on the document log loss; the sample's class balance is put back to prior."""
    model = Model(prior)
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return model
    parts, docs = [], []
    for a, b in slices(texts):
        x, doc = passages(texts[a:b])
        parts.append(x)
        docs.append(doc + a)
    x, doc, n = np.vstack(parts), np.concatenate(docs), len(texts)
    model.mean, model.std = x.mean(0), x.std(0) + 0.01
    x = ((x - model.mean) / model.std).astype(np.float32)
    r = np.random.default_rng(SEED)
    shapes = {"w": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}
    p = model.p = {k: (r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) and k not in "b" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / n
    for step in range(1, STEPS + 1):
        g = gradients(model, x, doc, n, y, cost)
        for k in p:
            grad = g[k] + DECAY * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
            p[k] = (p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    prior = min(max(prior, 0.001), 0.999)
    model.shift = float(np.log(prior / (1 - prior)))  # the loss weighs both classes alike
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Learns from a bounded sample: about per_label rows of each class, held-out rows never; of a row longer than SAMPLE_CHARS evenly
    spaced pieces from its start to its end. Repeated rows of one id and text count once; null text counts as empty."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, FOLD)).distinct()
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    picked = label_sample(known, "y", per_label)
    found = docs.select("doc_id", "text").join(small(picked, 64), "doc_id")
    rows = found.select("doc_id", cut(F.coalesce("text", F.lit("")), SAMPLE_CHARS).alias("text"), "y").distinct().orderBy("doc_id", "text", "y").select("text", "y").collect()
    return train([r.text for r in rows], [r.y for r in rows], counts.get(1, 0) / total if total else 0.5)


def scored(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """docs with the score (probability of label 1) of each whole text.

    Null counts as empty, and an empty text is one passage without characters. Texts that tie in their features, repeated rows above
    all, get equal scores; an empty table gives an empty one. A text longer than a block is a block of its own, at some 100 bytes of
    memory a character. A column named as `out` is replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(by_block(texts, shared.value.score_texts), dtype="float64")

    return docs.withColumn(out, score(F.col("text")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below threshold; columns as given. Edge cases as in scored(); without two classes of labels none goes."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].alias("text"))
    return scored(rows, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")
