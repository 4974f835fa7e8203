"""Pluggable text embedding: a function of a list of texts, applied once per distinct text in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.chunking import embedded

Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str], dimension: int = 64) -> np.ndarray:
    """The default embedder: unit vectors of hashed word counts; zero for a text without words."""
    return np.stack([embedded(t, dimension) for t in texts]) if texts else np.zeros((0, dimension))


def embed(df: DataFrame, text: str, out: str, load: Callable[[], Embedder] = lambda: hashed, batch: int = 256) -> DataFrame:
    """df with vectors of a text column; load() makes the embedder once per worker. Null counts as empty; a column named `out` is replaced."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            texts = ["" if t is None else t for t in s]
            parts = [model(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series([v.astype(np.float32) for p in parts for v in p], dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def embed_distinct(df: DataFrame, text: str, out: str, load: Callable[[], Embedder] = lambda: hashed) -> DataFrame:
    """As embed, but every distinct text is embedded once and joined back by its digest."""
    keyed = df.withColumn("_d", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    once = embed(keyed.groupBy("_d").agg(F.first(text).alias("_t")), "_t", out, load).select("_d", out)
    return keyed.join(once, "_d").drop("_d")


def digest_vector(text: str, dimension: int = 8) -> np.ndarray:
    """A vector from a text's digest: another embedder, for tests of the interface."""
    return np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)[:dimension] / 255.0


def relevant(candidates: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series], group: int = 5) -> DataFrame:
    """candidates (query, id, question, text) that judge(question, text) keeps, asked in groups of `group`; if it fails, the group is kept."""

    @F.pandas_udf("boolean")
    def kept(questions: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), group):
            try:
                out += judge(questions[i : i + group], texts[i : i + group]).tolist()
            except Exception:  # noqa: BLE001  the judge is foreign code
                out += [True] * len(texts[i : i + group])
        return pd.Series(out, dtype=bool)

    return candidates.where(kept("question", "text"))
