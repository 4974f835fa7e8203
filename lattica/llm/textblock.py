"""Whole texts as flat code point arrays, in blocks of bounded size, with their words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Parameter: code points handled at once; a longer text makes a block of its own.
BLOCK_CHARS = 400_000
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def slices(texts, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit characters in all."""
    start, used = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if used and used + n > limit:
            yield start, i
            start, used = i, 0
        used += n
    if start < len(texts):
        yield start, len(texts)


def by_block(texts: pd.Series, score) -> np.ndarray:
    """score(list of str) for each block; null counts as empty."""
    values = [t if isinstance(t, str) else "" for t in texts]
    out = [score(values[a:b]) for a, b in slices(values)]
    return np.concatenate(out) if out else np.zeros(0)


class TextBlock:
    """codes of all texts, one after the other; starts of texts; words are runs of characters that are no white space."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.cumsum([0, *map(len, texts)])

    def words(self, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (exclusive) of each word; a word also ends with its text."""
        inside = ~is_space
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.starts] = True
        opens = inside & (np.r_[True, ~inside[:-1]] | edge[:-1]) if len(inside) else inside
        closes = inside & (np.r_[~inside[1:], True] | edge[1:]) if len(inside) else inside
        return np.flatnonzero(opens), np.flatnonzero(closes) + 1


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_CHARS + 1)
        for name, r in (("up", _R), ("down", _R_INV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
        if size > 4 * BLOCK_CHARS:  # don't hold on to those of one very long text
            up, down = _POWERS.pop("up"), _POWERS.pop("down")
            return up, down
    return _POWERS["up"], _POWERS["down"]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of codes, exact modulo 2**64 and independent of where the span stands."""
    up, down = _powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
