"""Personal data: fixed base patterns, and a linear-chain conditional random field over word shapes.

The field learns from a small labelled table that `labelled_table` makes, and is decoded by Viterbi over all lines of a
block of texts at once. Its spans are added where no base span lies; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import forward_backward
from .textblock import BLOCK_CHARS, TextBlock, slices, span_hashes

# Kinds in order, their patterns and checks. Possessive and look-behind forms match the same as the plain ones.
BASE = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KINDS = (*BASE, "secret")
#: Labels: begin and inside of each kind.
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_AT = re.compile(r"@|[\[({<] ?at ?[\])}>]", re.IGNORECASE)
#: Marks that a decoded span neither begins nor ends with.
_BEFORE, _AFTER = frozenset(".,;:!?\"'([{<#*&%$|"), frozenset(".,;:!?\"')]}>#*&%$|")

#: Parameters: feature buckets; sentences of the labelled table; training steps.
BUCKETS, SENTENCES, STEPS, RATE, SEED = 1 << 12, 1500, 60, 0.3, 5


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, but only looking around each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = EMAIL.match(text, s) if s < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c in "0123456789" for c in m.group())
            if 9 <= n <= 15:
                out.append(("phone", *m.span()))
    return out


# Shapes: every character is a class; a word's shape is the sequence of its classes without repeats.
_SHAPE = np.full(0x300, 40, np.uint32)
for _c in range(0x300):
    _ch = chr(_c)
    _SHAPE[_c] = 0 if _c < 33 or _ch.isspace() else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _c < 128 and _ch.isdigit() else 4 + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(_ch) if _c < 127 else 1 if _ch.isalpha() else 40
_WIDE_SPACES = [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
N_FEATURES = 9


class Words:
    """Words (runs without white space) of texts with feature buckets (words x N_FEATURES), their lines and texts."""

    def __init__(self, texts: list[str]):
        block = self.block = TextBlock(texts)
        codes = block.codes
        cls = _SHAPE[np.minimum(codes, 0x2FF)]
        high = np.flatnonzero(codes >= 0x1680)
        if len(high):
            cls = cls.copy()
            cls[high[np.isin(codes[high], _WIDE_SPACES)]] = 0
        self.start, self.end = block.words(cls == 0)
        n = len(self.start)
        self.doc = np.searchsorted(block.starts, self.start, side="right") - 1
        breaks = np.cumsum(codes == 10)
        line = breaks[self.start] if n else np.zeros(0, np.int64)
        self.first = np.r_[True, (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])] if n else np.zeros(0, bool)
        if not n:
            self.features = np.zeros((0, N_FEATURES), np.int64)
            return
        fresh = np.ones(len(cls), bool)
        fresh[1:] = cls[1:] != cls[:-1]
        fresh[self.start] = True
        at = np.r_[0, np.cumsum(fresh)]
        shape = self._bucket(1, span_hashes(cls[fresh], at[self.start], at[self.end]))
        size = self.end - self.start
        digits, letters, lower = (np.r_[0, np.cumsum(x)] for x in (cls == 3, (cls == 1) | (cls == 2), cls == 1))
        n_digit, n_letter = digits[self.end] - digits[self.start], letters[self.end] - letters[self.start]
        hexa = np.r_[0, np.cumsum((cls == 3) | ((codes >= 97) & (codes <= 102)))]
        n_hex = hexa[self.end] - hexa[self.start]
        counts = self._bucket(2, _step(n_digit) * 64 + _step(n_letter) * 8 + _step(size - n_digit - n_letter))
        hexes = self._bucket(3, _step(n_hex) * 64 + _step(size - n_hex) * 8 + (n_digit > 0))
        ends = self._bucket(4, cls[self.start].astype(np.int64) * 64 + cls[self.end - 1])
        head = np.minimum(size, 8)
        known = self._bucket(5, span_hashes(np.where((codes >= 65) & (codes <= 90), codes + 32, codes), self.start, self.start + head))
        plain = n_letter == size
        known = np.where(size <= 24, known, 0)
        before, after = np.r_[True, self.first[1:]], np.r_[self.first[1:], True]
        kind = self._bucket(6, _step(n_digit) * 4096 + cls[self.start].astype(np.int64) * 64 + cls[self.end - 1])
        left = np.where(before, 1, np.r_[0, kind[:-1]])
        right = np.where(after, 2, np.r_[kind[1:], 0])
        word_left = np.where(before | ~np.r_[False, plain[:-1] | (size[:-1] <= 10)], 3, np.r_[0, known[:-1]])
        word_right = np.where(after | ~np.r_[plain[1:] | (size[1:] <= 10), False], 4, np.r_[known[1:], 0])
        self.features = np.stack([shape, counts, hexes, ends, known, (left * 31 + 7) % BUCKETS, (right * 37 + 11) % BUCKETS, (word_left * 41 + 13) % BUCKETS, (word_right * 43 + 17) % BUCKETS], 1)

    @staticmethod
    def _bucket(salt: int, x: np.ndarray) -> np.ndarray:
        h = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _step(n: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 2, 3, 5, 9, 13, 17], n, side="right")


class Model:
    def __init__(self):
        k = len(LABELS)
        self.tables = np.zeros((N_FEATURES, BUCKETS, k))
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def emission(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), len(LABELS)))
        for i in range(N_FEATURES):
            out += self.tables[i][features[:, i]]
        return out

    def labels(self, words: Words) -> np.ndarray:
        return viterbi(self.emission(words.features), words.first, self.trans, self.start)

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]] | None = None) -> list[list[tuple[str, int, int]]]:
        """Decoded spans of each text: a begin label and the inside labels after it, less the words that touch one of the text's base
        spans, without marks around what is left, if that can be of the kind."""
        words = Words(texts)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        y = self.labels(words)
        hit = np.flatnonzero(y)
        if not len(hit):
            return out
        kind, begins = (y[hit] - 1) // 2, y[hit] % 2 == 1
        doc = words.doc[hit]
        offset = words.block.starts[doc]
        start, end = words.start[hit] - offset, words.end[hit] - offset
        new = begins | np.r_[True, (np.diff(hit) > 1) | (kind[1:] != kind[:-1]) | words.first[hit[1:]]]
        if base is not None:
            free = np.array([not any(s < e1 and s1 < e for _, s1, e1 in base[d]) for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)])
            new[1:] |= ~free[:-1]
        else:
            free = np.ones(len(hit), bool)
        run = np.cumsum(new)[free]
        if not len(run):
            return out
        doc, kind, start, end = doc[free], kind[free], start[free], end[free]
        at = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(run)], strict=True):
            d, k = int(doc[i]), KINDS[kind[i]]
            span = trimmed(texts[d], int(start[i]), int(end[j - 1]))
            if evident(k, texts[d][span[0] : span[1]]):
                out[d].append((k, *span))
        return out


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in _BEFORE and not (text[s] == "(" and text.find(")", s, e) > 0):
        s += 1
    while e > s and text[e - 1] in _AFTER and not (text[e - 1] == ")" and text.find("(", s, e) >= 0):
        e -= 1
    return s, e


def evident(kind: str, found: str) -> bool:
    """Whether a decoded span can be of its kind: an at sign and a dot, four parts of at most 255, a Luhn number, 7 to 15 digits, or a long value with a digit."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "email":
        m = _AT.search(found)
        return m is not None and m.start() > 0 and "." in found[m.end() : -1]
    if kind == "ip":
        parts = re.findall("[0-9]+", found)
        return len(parts) >= 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts[:4])
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return len(found) >= 8 and bool(digits)


#: Words of a segment of a chain that is decoded side by side with all others.
SEGMENT = 32


def viterbi(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best labels of chains in one array (first marks where a chain begins).

    Chains are cut into segments, which are all decoded at once from guessed entry scores; then those whose entry scores differ from
    what the segment before them gave are decoded again, until none does. The scores of a chain's first segment are right at once,
    so by induction all are in the end. Back pointers of segments are followed for every label at once, and then chained.
    """
    n, k = emission.shape
    y = np.zeros(n, np.int64)
    if not n:
        return y
    chain = np.flatnonzero(first)
    length = np.diff(np.r_[chain, n])
    pieces = -(-length // SEGMENT)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(chain, pieces) + nth * SEGMENT
    size = np.diff(np.r_[begin, n])
    opens = nth == 0
    back = np.zeros((n, k), np.int8)
    enter, leave = np.zeros((len(begin), k)), np.zeros((len(begin), k))
    todo = np.arange(len(begin))
    while len(todo):
        todo = todo[np.argsort(-size[todo], kind="stable")]  # those that have an i-th word come first
        b, m = begin[todo], size[todo]
        score, arg = _step_on(enter[todo], trans)
        back[b] = arg
        score = np.where(opens[todo, None], start, score) + emission[b]
        for i in range(1, int(m[0])):
            live = int(np.searchsorted(-m, -i))
            best, arg = _step_on(score[:live], trans)
            score[:live] = best + emission[b[:live] + i]
            back[b[:live] + i] = arg
        leave[todo] = score - score.max(1, keepdims=True)
        given = np.vstack([np.zeros((1, k)), leave[:-1]])
        given[opens] = 0
        todo = np.flatnonzero((given != enter).any(1))
        enter = given
    order = np.argsort(-size, kind="stable")
    b, m = begin[order], size[order]
    origin = np.tile(np.arange(k), (len(b), 1))  # label of a segment's first word, then of the word before it, for each label of its last
    for i in range(int(m[0]) - 1, -1, -1):
        live = int(np.searchsorted(-m, -i))
        origin[:live] = np.take_along_axis(back[b[:live] + i], origin[:live], 1)
    came = np.empty_like(origin)
    came[order] = origin
    last, ends = leave.argmax(1), np.zeros(len(begin), np.int64)
    closes = np.r_[opens[1:], True]
    now = 0
    for j in range(len(begin) - 1, -1, -1):
        now = int(last[j]) if closes[j] else now
        ends[j] = now
        now = int(came[j, now])
    now = ends[order]
    for i in range(int(m[0]) - 1, -1, -1):
        live = int(np.searchsorted(-m, -i))
        y[b[:live] + i] = now[:live]
        now[:live] = back[b[:live] + i, now[:live]]
    return y


def _step_on(score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score of each next label, and the label before it (the least of equal ones)."""
    best = score[:, :1] + trans[0]
    arg = np.zeros(best.shape, np.int8)
    for a in range(1, len(trans)):
        other = score[:, a : a + 1] + trans[a]
        arg[other > best] = a
        np.maximum(best, other, out=best)
    return best, arg


def labelled_table(sentences: int = SENTENCES, seed: int = SEED) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences of (word, label), made from templates; many hold numbers that are no personal data."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    digits = lambda n: "".join(str(d) for d in r.integers(0, 10, n))
    letters = lambda a, b: "".join(pick("abcdefghiklmnoprstuvwyzéüñ") for _ in range(int(r.integers(a, b))))
    hexes = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))

    def word():
        w = letters(1, 14)
        w = w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.05 else w
        return w + pick(["", "", "", "", ",", ".", "!", "***", "%%%", "###", "&&&", "$$$", "!!"])

    def nothing():
        return [[digits(4)], [digits(2) + "%"], [digits(1) + "." + digits(2)], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"v{digits(1)}.{digits(1)}.{digits(2)}"], [digits(int(r.integers(1, 7)))],
                ["version", digits(1) + "."], ["|"], ["=", letters(3, 8)], ["$" + digits(3)], [digits(3) + "," + digits(3)], ["(" + letters(2, 6) + ")"], ["http://" + letters(3, 8) + ".org/" + letters(3, 6)], ["password", letters(2, 8)], ["token", letters(2, 8)], ["-", "-"], ["Nr.", digits(5)]]

    def personal():
        local, host = letters(3, 9) + pick(["", "."]) + digits(int(r.integers(0, 3))), letters(3, 8) + "." + pick(["com", "org", "net"])
        p1, p2, p3 = digits(3), digits(3), digits(4)
        return [
            ("email", [f"{local}@{host}"]), ("email", [f"<{local}@{host}>"]), ("email", [local, pick(["(at)", "[at]", "{at}", "(AT)", "<at>"]), host]), ("email", [local, pick(["(at)", "[at]"]), host]), ("email", [local + pick(["(at)", "[at]"]) + host]),
            ("phone", [f"+1", f"({p1})", f"{p2}-{p3}"]), ("phone", [f"({p1})", f"{p2}-{p3}"]), ("phone", [f"{p1}-{p2}-{p3}"]), ("phone", [f"{p1}.{p2}.{p3}"]), ("phone", [f"+{digits(2)}", p1, p2, p3]), ("phone", [f"+{digits(11)}"]),
            ("ip", [".".join(str(int(x)) for x in r.integers(1, 256, 4))]), ("ip", [".".join(str(int(x)) for x in r.integers(1, 256, 4)) + ":8080"]),
            ("card", [pick("345") + digits(15)]), ("card", [pick("345") + digits(3), digits(4), digits(4), digits(4)]), ("card", ["-".join([pick("345") + digits(3), digits(4), digits(4), digits(4)])]),
            ("secret", ["password=" + hexes(18)]), ("secret", ["password=" + letters(3, 7) + digits(4)]), ("secret", ["token=" + hexes(int(r.integers(20, 44)))]), ("secret", ["api_key=" + hexes(32)]), ("secret", [f'"{hexes(40)}"']), ("secret", ["secret:" + hexes(24)]), ("secret", ["AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))]),
        ]

    table = []
    for _ in range(sentences):
        sentence: list[tuple[str, str]] = []
        for _ in range(int(r.integers(1, 4))):
            sentence += [(word(), "O") for _ in range(int(r.integers(1, 9)))]
            if r.random() < 0.5:
                sentence += [(w, "O") for w in pick(nothing())]
            else:
                kind, ws = pick(personal())
                if kind == "secret" and ws[0].startswith('"'):
                    sentence += [(pick(["token", "key", "secret"]), "O"), ("=", "O")]
                end = pick(["", "", "", ".", ","])
                sentence += [(w + (end if i == len(ws) - 1 else ""), f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(ws)]
                if r.random() < 0.2:  # a neighbour, of the same kind half the time
                    near = [x for x in personal() if x[0] == kind] if r.random() < 0.5 else personal()
                    kind, ws = pick(near)
                    sentence += [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(ws)]
        sentence += [(word(), "O") for _ in range(int(r.integers(0, 6)))]
        if r.random() < 0.1:
            sentence += [(word(), "O")] * int(r.integers(2, 12))
        table.append(sentence)
    return table


def train(table: list[list[tuple[str, str]]]) -> Model:
    """Adagrad on the log likelihood of the table's labels; deterministic."""
    model = Model()
    words = Words(["\n".join(" ".join(w for w, _ in s) for s in table)])
    y = np.array([LABELS.index(label) for s in table for _, label in s])
    if not len(y):
        return model
    n, k = len(y), len(LABELS)
    gold = np.eye(k)[y]
    inside = ~words.first[1:]
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (y[:-1][inside], y[1:][inside]), 1)
    gold_s = np.bincount(y[words.first], minlength=k)
    seen = [np.full_like(x, 1e-8) for x in (model.tables, model.trans, model.start)]
    for _ in range(STEPS):
        post, moved = forward_backward(model.emission(words.features), words.first, model.trans, model.start, pairs=True)
        miss = (gold - post) / n
        g = np.stack([np.stack([np.bincount(words.features[:, i], miss[:, j], minlength=BUCKETS) for j in range(k)], 1) for i in range(N_FEATURES)])
        for p, grad, s in zip((model.tables, model.trans, model.start), (g - 1e-6 * model.tables, (gold_t - moved) / n, (gold_s - post[words.first].sum(0)) / n), seen, strict=True):
            s += grad * grad
            p += RATE * grad / np.sqrt(s)
    return model


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_table())


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def all_spans(base: list[tuple[str, int, int]], added: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Both, by kind, then start; added ones overlap none of the base."""
    return sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def found(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with pii: counts of base kinds, base_sha256, spans (text form), n_secret and n_found (secrets, all spans) of each whole text.

    Null and empty texts have no spans. A base span always stays; a decoded one loses the words that touch a base span, and what is
    left of it overlaps no other. Decoded spans that stand side by side are told apart by their begin labels; labels that tie go to
    the first of LABELS. Repeated rows get equal spans; an empty table gives an empty one. A text longer than a block is a block of
    its own, at some 150 bytes of memory a character. A column named pii is replaced, others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_found long")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values = [t if isinstance(t, str) else "" for t in texts]
            out = []
            for a, b in slices(values, BLOCK_CHARS):
                bases = [base_spans(t) for t in values[a:b]]
                for base, added in zip(bases, shared.value.added(values[a:b], bases), strict=True):
                    kinds = [x[0] for x in base]
                    every = all_spans(base, added)
                    secrets = sum(x[0] == "secret" for x in every)
                    out.append((*(kinds.count(x) for x in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), secrets, len(every)))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_found"])

    rest = [c for c in docs.columns if c != "pii"]
    return docs.select(*[docs[f"`{c}`"] for c in rest], find(docs["text"]).alias("pii"))
