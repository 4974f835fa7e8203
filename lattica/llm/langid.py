"""Language ID: a linear-chain conditional random field over words, decoded by forward-backward.

Features of a word are its affixes, character n-grams and its entry in a learned lexicon; transitions and starts are learned
with them, on sequences put together from pieces of labelled rows so that languages alternate. The posteriors of the words give
the language of each word of code-switched text and, summed, that of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, label_sample
from .textblock import BLOCK_CHARS, TextBlock, slices, span_hashes

#: Parameters: labelled rows of each language to learn from, and characters of a row (pieces of longer ones); table size, training steps.
PER_LABEL, SAMPLE_CHARS = 300, 8000
BUCKETS, STEPS, RATE, DECAY, SEED, LEXICON_MIN = 1 << 17, 40, 0.25, 1e-6, 11, 4
PIECE_WORDS = (3, 40)
FOLDS, FOLD = 5, 0
SCAN = 64
UNKNOWN = "und"

_ALPHA = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
_PRIMES = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def is_letter(codes: np.ndarray) -> np.ndarray:
    out = _ALPHA[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        u, inv = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([chr(c).isalpha() for c in u])[inv]
    return out


def _buckets(salt: int, *cols: np.ndarray) -> np.ndarray:
    h = np.full(len(cols[0]), salt, np.uint64)
    for c, p in zip(cols, _PRIMES, strict=False):
        h = (h ^ c.astype(np.uint64)) * p
        h ^= h >> np.uint64(31)
    return (h % np.uint64(BUCKETS)).astype(np.int64)


class Words:
    """Distinct words of a block with their features, and which of them each word is."""

    def __init__(self, codes: np.ndarray, w0: np.ndarray, w1: np.ndarray):
        self.hash, first, self.which = np.unique(span_hashes(codes, w0, w1), return_index=True, return_inverse=True)
        u0, u1 = w0[first], w1[first]
        n = len(u0)
        size = u1 - u0 + 2
        at = np.cumsum(size) - size
        wid = np.repeat(np.arange(n), size)
        rel = np.arange(len(wid)) - at[wid]
        flat = np.full(len(wid), 1, np.uint32)  # 1 marks both ends of a word
        inner = (rel > 0) & (rel < size[wid] - 1)
        flat[inner] = codes[u0[wid[inner]] + rel[inner] - 1]
        self.n = n
        #: features: (bucket, word, weight); words ascend
        two, three = wid[1:] == wid[:-1], wid[2:] == wid[:-2]
        w = (3.0 / size).astype(np.float32)
        self.features = [
            (_buckets(2, flat[:-1][two], flat[1:][two]), wid[1:][two], w),
            (_buckets(3, flat[:-2][three], flat[1:-1][three], flat[2:][three]), wid[2:][three], w),
        ]
        for k in (2, 3, 4):
            long = np.flatnonzero(size - 2 >= k)
            half = np.full(n, 0.5, np.float32)
            self.features.append((_buckets(10 + k, *(codes[u0[long] + i] for i in range(k))), long, half))
            self.features.append((_buckets(20 + k, *(codes[u1[long] - 1 - i] for i in range(k))), long, half))

    def scores(self, table: np.ndarray, lexicon: np.ndarray, entries: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, table.shape[1]), np.float32)
        if not self.n:
            return out
        for bucket, word, weight in self.features:
            if len(word):
                first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                out[word[first]] += np.add.reduceat(table[bucket], first) * weight[word[first], None]
        i = self.entry(lexicon)
        out[i >= 0] += entries[i[i >= 0]]
        return out

    def entry(self, lexicon: np.ndarray) -> np.ndarray:
        if not len(lexicon):
            return np.full(self.n, -1)
        i = np.minimum(np.searchsorted(lexicon, self.hash), len(lexicon) - 1)
        return np.where(lexicon[i] == self.hash, i, -1)


def forward_backward(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Posteriors of a run of chains in one array (first marks where a chain begins), and expected transitions if asked for.

    The array is cut into blocks; the matrix product over each block is found for all blocks at once, a short scan over the
    blocks gives what enters each, and a second pass over all blocks at once gives every position. This is exact.
    """
    n, k = emission.shape
    if not n:
        return emission.astype(np.float64), np.zeros((k, k))
    size = min(SCAN, max(1, int(np.sqrt(n))))
    blocks = -(-n // size)
    e = np.ones((blocks * size, k))
    e[:n] = np.exp(emission - emission.max(1, keepdims=True))
    f = np.ones(blocks * size, bool)
    f[:n] = first
    e, f = e.reshape(blocks, size, k), f.reshape(blocks, size)
    t, s = np.exp(trans), np.exp(start)
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(size):
        nxt = product @ t
        at = f[:, i]
        if at.any():
            nxt[at] = product[at].sum(2, keepdims=True) * s
        product = nxt * e[:, i, None, :]
        product /= product.sum((1, 2), keepdims=True)
    enter = np.empty((blocks, k))
    leave = np.empty((blocks, k))
    a = np.full(k, 1.0 / k)
    for b in range(blocks):
        enter[b] = a
        a = a @ product[b]
        a /= a.sum()
    a = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        leave[b] = a
        a = product[b] @ a
        a /= a.sum()
    alpha = np.empty_like(e)
    a = enter
    for i in range(size):
        nxt = a @ t
        at = f[:, i]
        nxt[at] = a[at].sum(1, keepdims=True) * s
        a = nxt * e[:, i]
        a /= a.sum(1, keepdims=True)
        alpha[:, i] = a
    beta = np.empty_like(e)
    a = leave
    for i in range(size - 1, -1, -1):
        beta[:, i] = a
        if i:
            back = e[:, i] * a
            a = back @ t.T
            at = f[:, i]
            a[at] = (back[at] @ s)[:, None]
            a /= a.sum(1, keepdims=True)
    post = (alpha * beta).reshape(-1, k)[:n]
    post /= post.sum(1, keepdims=True)
    moved = np.zeros((k, k))
    if pairs:
        al, eb = alpha.reshape(-1, k)[: n - 1], (e * beta).reshape(-1, k)[1:n]
        inside = ~f.reshape(-1)[1:n]
        al, eb = al[inside], eb[inside]
        total = np.einsum("ni,ij,nj->n", al, t, eb)
        moved = ((al / total[:, None]).T @ eb) * t
    return post, moved


class Model:
    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.table = np.zeros((BUCKETS, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)
        self.lexicon, self.entries = np.zeros(0, np.uint64), np.zeros((0, k), np.float32)

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each word's language, and the text that each word is in."""
        block = TextBlock([t.lower() for t in texts])
        w0, w1 = block.words(~is_letter(block.codes))
        words = Words(block.codes, w0, w1)
        doc = np.searchsorted(block.starts, w0, side="right") - 1
        emission = words.scores(self.table, self.lexicon, self.entries)[words.which]
        first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        return forward_backward(emission, first, self.trans, self.start)[0], doc

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.labels)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        post, doc = self.posteriors(texts)
        mass = np.stack([np.bincount(doc, post[:, j], minlength=n) for j in range(k)], 1)
        count = np.bincount(doc, minlength=n)
        best = mass.argmax(1)
        score = np.where(count > 0, mass[np.arange(n), best] / np.maximum(count, 1), 0.0)
        return [self.labels[b] if c else UNKNOWN for b, c in zip(best, count, strict=True)], np.clip(score, 0, 1)

    def runs(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, end, language) of the runs of equally labelled words of one text."""
        post, _ = self.posteriors([text])
        y = post.argmax(1)
        cut = np.flatnonzero(np.r_[True, y[1:] != y[:-1]]) if len(y) else []
        return [(int(a), int(b), self.labels[y[a]]) for a, b in zip(cut, [*cut[1:], len(y)], strict=True)]


def train(texts: list[str], langs: list[str]) -> Model:
    """Adagrad on the log likelihood of word labels; each training row lends its label to its words."""
    labels = sorted(set(langs))
    model = Model(labels)
    if not labels:
        return model
    k = len(labels)
    block = TextBlock([t.lower() for t in texts])
    w0, w1 = block.words(~is_letter(block.codes))
    if not len(w0):
        return model
    words = Words(block.codes, w0, w1)
    doc = np.searchsorted(block.starts, w0, side="right") - 1
    y_doc = np.array([labels.index(x) for x in langs])
    r = np.random.default_rng(SEED)
    cuts, at = [], 0  # pieces of rows, dealt anew so that languages alternate
    ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) + 1
    for end in ends:
        while at < end:
            nxt = min(int(end), at + int(r.integers(*PIECE_WORDS)))
            cuts.append((at, nxt))
            at = nxt
    order = r.permutation(len(cuts))
    seq = np.concatenate([np.arange(*cuts[i]) for i in order])
    which, y = words.which[seq], y_doc[doc[seq]]
    first = np.zeros(len(seq), bool)
    lengths = np.array([cuts[i][1] - cuts[i][0] for i in order])
    first[(np.cumsum(lengths) - lengths)[:: 4]] = True  # four pieces make a sequence
    count = np.bincount(words.which, minlength=words.n)
    model.lexicon = words.hash[count >= LEXICON_MIN]
    model.entries = np.zeros((len(model.lexicon), k), np.float32)
    entry = words.entry(model.lexicon)
    gold_t = np.zeros((k, k))
    inside = ~first[1:]
    np.add.at(gold_t, (y[:-1][inside], y[1:][inside]), 1)
    gold_s = np.bincount(y[first], minlength=k)
    n = len(seq)
    seen = [np.full_like(p, 1e-8, dtype=np.float64) for p in (model.table, model.entries, model.trans, model.start)]
    gold = np.zeros((n, k))
    gold[np.arange(n), y] = 1
    for _ in range(STEPS):
        emission = words.scores(model.table, model.lexicon, model.entries)[which]
        post, moved = forward_backward(emission, first, model.trans, model.start, pairs=True)
        miss = gold - post
        by_word = np.stack([np.bincount(which, miss[:, j], minlength=words.n) for j in range(k)], 1) / n
        g_table = np.zeros((BUCKETS, k))
        for bucket, word, weight in words.features:
            for j in range(k):
                g_table[:, j] += np.bincount(bucket, by_word[word, j] * weight[word], minlength=BUCKETS)
        g_entries = by_word[entry >= 0]
        g_entries = g_entries[np.argsort(entry[entry >= 0])]
        grads = (g_table - DECAY * model.table, g_entries - DECAY * model.entries, (gold_t - moved) / n, (gold_s - post[first].sum(0)) / n)
        for name, g, s in zip(("table", "entries", "trans", "start"), grads, seen, strict=True):
            s += g * g
            p = getattr(model, name)
            setattr(model, name, (p + RATE * g / np.sqrt(s)).astype(p.dtype))
    return model


def fit(docs: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learns from a bounded sample: about per_label rows of every language, held-out rows never; of a row longer than SAMPLE_CHARS
    evenly spaced pieces from its start to its end. Repeated rows of one id and text count once."""
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, FOLD))
    picked = label_sample(known, "lang", per_label, ("doc_id", "text")).select("doc_id", "lang", cut(F.col("text"), SAMPLE_CHARS).alias("text"))
    rows = picked.distinct().orderBy("doc_id", "text", "lang").collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred (a learned language; und for null and for texts without a letter) and score of each whole text.

    Languages that tie go to the first by name. Repeated rows get equal results; an empty table gives an empty one. A text longer
    than a block is a chain in a block of its own, at some 300 bytes of memory a character. Columns named lang_pred and score are
    replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [t if isinstance(t, str) else "" for t in texts]
            lang, score = [], []
            for a, b in slices(values, BLOCK_CHARS):
                one, two = shared.value.predict(values[a:b])
                lang += one
                score += two.tolist()
            yield pd.DataFrame({"lang_pred": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype="float64")})

    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # the result replaces lang_pred, so that no other column can have its name
    out = docs.select(*[docs[f"`{c}`"] for c in rest], predict(docs["text"]).alias("lang_pred"))
    return out.select(*[f"`{c}`" for c in rest], F.col("lang_pred.lang_pred").alias("lang_pred"), F.col("lang_pred.score").alias("score"))
