"""Vector expressions on ARRAY columns; sums are taken in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """No guard: null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_epsilon(a: Column | str, b: Column | str) -> Column:
    """EPSILON in the denominator; negatives become 0."""
    return F.greatest(F.lit(0.0), dot(a, b) / (norm(a) * norm(b) + EPSILON))


def cosine_or_zero(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is zero; negatives become 0."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), dot(a, b) / F.when(d != 0, d)))


def normalised(a: Column | str) -> Column:
    n = norm(a)
    return F.transform(_col(a), lambda x: F.when(n == 0, x).otherwise(x / F.when(n != 0, n)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity_of_squared(d: Column) -> Column:
    """Cosine of unit vectors from their squared distance."""
    return 1 - d / 2


def score_of_distance(d: Column) -> Column:
    return 1 / (1 + d)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def is_valid(a: Column | str, dimension: int) -> Column:
    """Right dimension and not all zero; null isn't valid."""
    return F.coalesce((F.size(_col(a)) == dimension) & F.exists(_col(a), lambda x: x != 0), F.lit(False))


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, mean: the mean of a key's vectors. Means are aggregated by dimension, so no group is gathered in one task."""
    parts = df.select(key, F.posexplode(_col(vector)).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("p")).select(key, F.transform("p", lambda s: s["x"]).alias("mean"))


def hashed_embedding(df: DataFrame, keys: list[str], tokens: str, dimension: int = 64) -> DataFrame:
    """keys, bucket, x: unit vectors of hashed token counts, as (bucket, value) rows. Rows without tokens have none."""
    bucket = F.conv(F.substring(F.md5(F.col("tok").cast("binary")), 1, 4), 16, 10).cast("int") % dimension
    counts = df.select(*keys, F.explode(tokens).alias("tok")).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    norms = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, keys).select(*keys, "bucket", (F.col("n") / F.col("norm")).alias("x"))


def hashed_vector(tokens: Column | str, dimension: int = 64) -> Column:
    """The hashed token counts of a row as one array; all zero without tokens. Tokens are hashed by built-in functions, counted in Arrow batches."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return _counted(dimension)(F.transform(t, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 4), 16, 10).cast("int") % dimension))


def _counted(dimension: int):
    @F.pandas_udf("array<double>")
    def counts(buckets: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(b, minlength=dimension).astype(float) if b is not None and len(b) else np.zeros(dimension) for b in buckets])

    return counts
