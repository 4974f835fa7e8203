"""Best-fit packing under conflicts: no bin holds two pieces of one source or of one cluster of duplicates.

Pieces are dealt by a hash into shards of bounded expected size, each packed by itself in a task of its own number, so a hot
source, cluster or text spreads evenly.
In a shard pieces come by falling size. Open bins are ordered by what is left of them; each carries a bitmap of its sources and
one of its duplicate clusters. The search starts at the tightest bin that has room and goes on to the next larger one until the
bitmaps are disjoint from the piece's; only if no open bin is compatible, a new one is opened. For sources an index of residuals
skips the bins that hold the source, so a hot source doesn't walk them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import located, written

#: Parameters: tokens in a bin; pieces that a shard has on average; tasks at most, each of which packs its shards one after the other.
CAPACITY, SHARD_PIECES, MAX_TASKS = 2048, 10_000, 100_000
#: Pieces of a source in a shard from which it has an index of residuals.
FREQUENT = 32


class Bins:
    """Open bins by residual. avail[s] has bit r set iff some bin with residual r lacks source s, one of the n_sources frequent ones."""

    def __init__(self, capacity: int, n_sources: int):
        self.capacity = capacity
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]  # residual -> bitmap of sources -> stack of bins
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []
        self.n_at = [0] * (capacity + 1)  # open bins by residual
        self.holding = np.zeros((n_sources, capacity + 1), np.int32)  # of these, bins that hold the source
        self.avail = [0] * n_sources
        self.open = 0  # bit r: some bin has residual r
        self.n_sources = n_sources
        self.members: list[list[int]] = []

    def _moved(self, residual: int, step: int, sources: list[int]) -> None:
        self.n_at[residual] += step
        self.holding[[s for s in sources if s < self.n_sources], residual] += step
        lacking = self.holding[:, residual] < self.n_at[residual]
        bit = 1 << residual
        self.open = self.open | bit if self.n_at[residual] else self.open & ~bit
        for s, free in enumerate(lacking.tolist()):
            self.avail[s] = self.avail[s] | bit if free else self.avail[s] & ~bit

    def find(self, size: int, source: int, cluster: int) -> int:
        """The compatible bin with the least residual of at least size (-1: none); of equal ones, the last touched of the first bitmap."""
        todo = (self.avail[source] if source < self.n_sources else self.open) >> size
        r = size
        while todo:
            step = (todo & -todo).bit_length() - 1
            r, todo = r + step, todo >> step
            for bitmap, stack in self.at[r].items():
                if not bitmap >> source & 1:
                    if cluster < 0:
                        return stack[-1]
                    for b in reversed(stack):
                        if not self.clusters[b] >> cluster & 1:
                            return b
            r, todo = r + 1, todo >> 1
        return -1

    def put(self, b: int, size: int, source: int, cluster: int) -> int:
        """Adds a piece to bin b (-1: a new one) and returns the bin."""
        if b < 0:
            b = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
            self.members.append([])
        elif self.left[b]:
            stack = self.at[self.left[b]][self.sources[b]]
            stack.remove(b)
            if not stack:
                del self.at[self.left[b]][self.sources[b]]
            self._moved(self.left[b], -1, self.members[b])
        self.left[b] -= size
        self.sources[b] |= 1 << source
        self.members[b].append(source)
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster
        if self.left[b]:
            self.at[self.left[b]].setdefault(self.sources[b], []).append(b)
            self._moved(self.left[b], 1, self.members[b])
        return b


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the given order. Sources are 0.. by falling frequency; a negative cluster conflicts with none."""
    bins = Bins(capacity, sum(n >= FREQUENT for n in Counter(sources).values()))
    out, offset = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        b = bins.put(bins.find(size, source, cluster), size, source, cluster)
        out.append(b)
        offset.append(capacity - bins.left[b] - size)
    return out, offset


OUT = "doc_id long, piece int, start long, n_tokens int, shard int, bin int, offset int"


def _packed_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins of one shard's pieces, which come by falling size."""
    together = pdf.groupby("cluster")["cluster"].transform("size") > 1
    dense = pd.factorize(pdf["cluster"].where(together))[0].tolist()  # -1 for those that are alone
    names = pdf["source"].isna().map({True: "", False: "s"}) + pdf["source"].fillna("")
    rank = {name: i for i, name in enumerate(names.value_counts().sort_index().sort_values(ascending=False, kind="stable").index)}
    b, at = pack(pdf["n_tokens"].tolist(), names.map(rank).tolist(), dense, capacity)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["piece"].astype("int64") * capacity, "n_tokens": pdf["n_tokens"], "shard": pdf["shard"], "bin": b, "offset": at}).astype({"doc_id": "Int64"})


def _packer(capacity: int):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:  # sorted by shard, each of which is in one partition
            for _, part in pdf.groupby("shard", sort=False):
                if held and held[0]["shard"].iloc[0] != part["shard"].iloc[0]:
                    yield _packed_shard(pd.concat(held, ignore_index=True), capacity)
                    held = []
                held.append(part)
        if held:
            yield _packed_shard(pd.concat(held, ignore_index=True), capacity)

    return packed


def n_words(text: Column) -> Column:
    """Words between white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+")
    empty = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.size(parts) - empty


def cluster_of(text: Column) -> Column:
    """Hash of the text without white space: rows that share it are duplicates here."""
    return F.xxhash64(F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", ""))


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start (token), n_tokens, shard, bin, offset in the bin; (shard, bin) names a bin.

    A text longer than a bin gives full pieces and a rest, however many they are; pieces of one text or of its duplicates never
    share a bin. A text without words (null, empty) is one piece of 0 tokens, in a bin -1. Null sources count as one source.
    Repeated rows are packed each. Pieces of equal size come by doc_id, piece and a hash of the stored row. An empty table gives an
    empty table. Columns other than doc_id, text and source aren't read, whatever their names; length and cluster are expressions
    on the columns of docs that replace word counts and text hashes.
    """
    size = F.coalesce(length if length is not None else n_words(F.col("text")), F.lit(0)).cast("int")
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), (cluster if cluster is not None else cluster_of(F.col("text"))).alias("cluster"))
    rows = written(located(own).select("row.*", F.xxhash64("file", "at").alias("rid")), "packing-rows")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    total = rows.agg(F.sum(n_pieces)).first()[0] or 0
    n_shards = max(1, math.ceil(total / shard_pieces))
    pieces = rows.select("doc_id", "rid", "source", "cluster", "size", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "rid", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n_tokens"), F.pmod(F.xxhash64("rid", "piece"), F.lit(n_shards)).cast("int").alias("shard"))
    n = min(n_shards, MAX_TASKS)
    placed = pieces.where("n_tokens > 0").repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard", F.desc("n_tokens"), "doc_id", "piece", "rid")
    some = placed.mapInPandas(_packer(capacity), OUT)
    none = pieces.where("n_tokens <= 0").select("doc_id", "piece", F.lit(0).cast("long").alias("start"), F.lit(0).alias("n_tokens"), "shard", F.lit(-1).alias("bin"), F.lit(0).alias("offset"))
    return some.unionByName(none)


def fill(bins: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_bins, n_tokens, fill (tokens over the room of all bins) of packed()'s result."""
    each = bins.where("bin >= 0").groupBy("shard", "bin").agg(F.sum("n_tokens").alias("n"))
    return each.agg(F.count(F.lit(1)).alias("n_bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill"))
