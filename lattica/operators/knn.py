"""Nearest neighbours: exact blocked search, adaptive cut, an inverted-file index, and neighbour lists over several features."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.operators.graph import settled

#: Parameters: rows of a block; rows that the inverted file's centres are fitted on, rows of a cell, Lloyd rounds.
BLOCK_ROWS = 2048
#: Parameters: bytes of query vectors in one pass over the base; base rows that meet them at once.
QUERY_BYTES, BASE_ROWS = 32 << 20, 8192
CENTRE_SAMPLE, CELL_ROWS, MAX_CELLS, ROUNDS, SEED = 20_000, 500, 4096, 8, 3  # beyond MAX_CELLS cells grow, and are searched in blocks
#: Share of a sample's true neighbours that the probed cells must hold, and rows of the sample that ask.
RECALL, ASKING, NEIGHBOURS = 0.97, 200, 10
# Fixed values of the adaptive cut.
FIRST, CUT_PERCENTILE, LEAST_STEP = 25, 95, 0.01


def blocks(df: DataFrame, id_col: str, vector: str, rows: int = BLOCK_ROWS, group: list[str] | None = None) -> DataFrame:
    """Rows packed into blocks of about `rows`: group.., ids, vectors. Blocks are dealt by hash, so a hot group is many blocks."""
    group = group or []
    n = max(1, math.ceil(df.count() / rows))
    dealt = df.select(*group, F.col(id_col).alias("_id"), F.col(vector).cast("array<float>").alias("_v"), F.pmod(F.xxhash64(id_col), F.lit(n)).alias("_b"))
    return dealt.groupBy(*group, "_b").agg(F.collect_list("_id").alias("ids"), F.collect_list("_v").alias("vectors")).drop("_b")


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _searcher(keys: list[str], k: int | None, least: float | None, exclude: bool):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                sims = _unit(r["q_vectors"]) @ _unit(r["b_vectors"]).T
                q, b = np.asarray(r["q_ids"]), np.asarray(r["b_ids"])
                if exclude:
                    sims[q[:, None] == b[None, :]] = -np.inf
                if k is not None and k < sims.shape[1]:
                    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    at = sims[np.arange(len(q))[:, None], part].min(1, keepdims=True)
                    keep = sims >= at - 1e-12  # ties are settled by id later
                else:
                    keep = np.ones(sims.shape, bool)
                keep &= np.isfinite(sims)
                if least is not None:
                    keep &= sims >= least
                i, j = np.nonzero(keep)
                yield pd.DataFrame({**{c: [r[c]] * len(i) for c in keys}, "src": q[i], "dst": b[j], "sim": sims[i, j]})

    return search


def near(queries: DataFrame, base: DataFrame, k: int | None = None, least: float | None = None, exclude: bool = True, slack: float = 1e-12) -> DataFrame:
    """src, dst, sim (cosine): all that can be among the k nearest (of each stretch of base rows, within slack of its k-th), or at least `least`.

    Base rows stay where they are; queries (id, vector) are broadcast, in passes of QUERY_BYTES at most, so that neither side's
    vectors are shuffled and what the driver holds is bounded. Beyond one pass each pass's result is a written table.
    """
    spark = base.sparkSession
    rows, first = queries.count(), queries.select(F.size("vector").alias("n")).first()
    passes = max(1, math.ceil(rows * max(first.n if first else 1, 1) * 8 / QUERY_BYTES))
    found = []
    for p in range(passes):
        some = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p)
        got = some.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).toArrow()
        ids = got.column("id").to_numpy()
        unit = _unit(got.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)) if len(ids) else np.zeros((0, 1))
        held = spark.sparkContext.broadcast((ids, unit))
        part = base.select("id", F.col("vector").cast("array<double>").alias("vector")).mapInPandas(_near(held, k, least, exclude, slack), "src long, dst long, sim double")
        if passes > 1:
            part = settled(part)
            held.unpersist()
        found.append(part)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _near(held, k: int | None, least: float | None, exclude: bool, slack: float):
    def found(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pd.DataFrame]:
        q_ids, q = held.value
        for a in range(0, len(q), 512):
            sims = q[a : a + 512] @ vectors.T
            if exclude:
                sims[q_ids[a : a + 512, None] == ids[None, :]] = -np.inf
            keep = np.isfinite(sims)
            if k is not None and k < sims.shape[1]:
                keep &= sims >= np.partition(sims, -k, axis=1)[:, -k, None] - slack  # ties are settled by id later
            if least is not None:
                keep &= sims >= least
            i, j = np.nonzero(keep)
            yield pd.DataFrame({"src": q_ids[a + i], "dst": ids[j], "sim": sims[i, j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, n = [], [], 0
        for pdf in batches:
            if len(pdf):
                ids.append(pdf["id"].to_numpy(np.int64))
                vectors.append(_unit(pdf["vector"]))
                n += len(pdf)
            if n >= BASE_ROWS:
                yield from found(np.concatenate(ids), np.vstack(vectors))
                ids, vectors, n = [], [], 0
        if n:
            yield from found(np.concatenate(ids), np.vstack(vectors))

    return run


def search(queries: DataFrame, base: DataFrame, k: int | None = None, least: float | None = None, exclude: bool = True, on: list[tuple[str, str]] | None = None) -> DataFrame:
    """src, dst, sim (cosine), rank: exact neighbours of queries (id, vector) in base (id, vector).

    Without groups as near(). `on` names group columns (of queries, of base) that must be equal; each side's come back as given, and
    blocks of queries meet blocks of base of the same group in one matrix product each.
    """
    keys = [a for a, _ in on or []]
    if not on:
        found = near(queries, base, k, least, exclude)
    else:
        q = blocks(queries, "id", "vector", group=keys).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
        b = blocks(base, "id", "vector", group=[x for _, x in on]).withColumnsRenamed({"ids": "b_ids", "vectors": "b_vectors"})
        renamed = b.withColumnsRenamed({x: f"_on_{i}" for i, (_, x) in enumerate(on)})
        pairs = q.join(renamed, [q[a] == renamed[f"_on_{i}"] for i, a in enumerate(keys)]).drop(*[f"_on_{i}" for i in range(len(on))])
        parallel = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        types = {f.name: f.dataType.simpleString() for f in q.schema}
        schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "src long, dst long, sim double"])
        found = pairs.repartition(parallel).mapInPandas(_searcher(keys, k, least, exclude), schema)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "src").orderBy(F.desc("sim"), "dst")).cast("long"))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


def canonical(edges: DataFrame) -> DataFrame:
    """One row per unordered pair: a < b and the similarity."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def adaptive_cut(found: DataFrame, keys: list[str], distance: str = "distance") -> DataFrame:
    """Neighbours up to the first sudden rise of the distance, by rank within keys.

    The relative rise is infinite from 0 to more and 0 from 0 to 0. The cut lies where the rise is infinite or at least the 95th
    percentile of the finite ones, and the step is at least that of all steps and LEAST_STEP. No such place: all; no finite rise: one.
    """
    w = W.partitionBy(*keys).orderBy("rank")
    d, nxt = F.col(distance), F.col("_next")
    steps = found.withColumn("_next", F.lead(distance).over(w)).withColumns({"_step": nxt - d, "_rise": F.when(d > 0, (nxt - d) / F.when(d > 0, d) * 100).when(nxt > 0, F.lit(float("inf"))).when(nxt.isNotNull(), F.lit(0.0))})
    finite = F.when(F.col("_rise") < float("inf"), F.col("_rise"))
    share = F.lit(CUT_PERCENTILE / 100)
    cuts = steps.groupBy(*keys).agg(F.percentile(finite, share).alias("_rise_cut"), F.percentile("_step", share).alias("_step_cut"), F.count(finite).alias("_finite"), F.count("_step").alias("_steps"))
    rated = steps.join(cuts, keys)
    breaks = ((F.col("_rise") == float("inf")) | (F.col("_rise") >= F.col("_rise_cut"))) & (F.col("_step") >= F.greatest("_step_cut", F.lit(LEAST_STEP)))
    stop = F.when((F.col("_steps") > 0) & (F.col("_finite") == 0), F.lit(1)).otherwise(F.min(F.when(breaks, F.col("rank"))).over(W.partitionBy(*keys)))
    kept = rated.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("rank") <= F.col("_stop")))
    return kept.select(*found.columns)


def weighted_fusion(found: DataFrame, weights: dict[str, float], query: str = "src", node: str = "dst") -> DataFrame:
    """query, node, score: similarities summed over features with the feature's weight."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("feature")]
    return found.groupBy(query, node).agg(F.sum(F.col("sim") * weight).alias("score"))


class InvertedFile:
    """Cells around centres that are fitted on a bounded sample; every row is indexed in its nearest cell.

    A query looks through the nearest cells and re-ranks exactly; how many is measured on the sample. Cells are searched block by block, so a hot cell is shared out.
    """

    def __init__(self, base: DataFrame, n_cells: int | None = None, probe: int | None = None):
        n = base.count()
        self.n_cells = n_cells or max(1, min(MAX_CELLS, n // CELL_ROWS + 1))
        share = min(1.0, CENTRE_SAMPLE / max(n, 1))
        rows = base.where(F.shiftrightunsigned(F.xxhash64("id", F.lit("centres")), 1).cast("double") / float(1 << 63) < share).orderBy("id").select("vector").collect()
        x = _unit([r.vector for r in rows]) if rows else np.zeros((1, 1))
        centres = x[np.random.default_rng(SEED).permutation(len(x))[: self.n_cells]]
        for _ in range(ROUNDS):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
        self.centres = centres
        self.probe = probe or self._probe_for(x)
        self.cells = self._celled(base, 1)

    def _probe_for(self, x: np.ndarray) -> int:
        """The fewest cells that hold RECALL of the true neighbours of some sample rows, so clustered data probes few and even data many."""
        asking = x[:: max(1, len(x) // ASKING)][:ASKING]
        sims = asking @ x.T
        k = min(NEIGHBOURS + 1, len(x))  # each row finds itself first
        near = np.argsort(-sims, axis=1, kind="stable")[:, 1:k]
        order = np.argsort(-(asking @ self.centres.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")  # of each cell in a row's order
        cell = (x @ self.centres.T).argmax(1)
        ranks = np.take_along_axis(place, cell[near], axis=1).ravel()
        return int(np.quantile(ranks, RECALL, method="higher")) + 1 if len(ranks) else 1

    def _celled(self, df: DataFrame, probe: int) -> DataFrame:
        centres = df.sparkSession.sparkContext.broadcast(self.centres)

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    sims = _unit(pdf["vector"]) @ centres.value.T
                    yield pdf.assign(cells=list(np.argsort(-sims, axis=1, kind="stable")[:, :probe].astype(np.int32)))

        cells = df.select("id", F.col("vector").cast("array<float>").alias("vector")).mapInPandas(nearest, "id long, vector array<float>, cells array<int>")
        return cells.select("id", "vector", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, exclude: bool = True) -> DataFrame:
        found = search(self._celled(queries, self.probe), self.cells, k, exclude=exclude, on=[("cell", "cell")])
        w = W.partitionBy("src").orderBy(F.desc("sim"), "dst")
        return found.drop("rank", "cell").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def features(df: DataFrame, id_col: str, parts: dict[str, Column]) -> DataFrame:
    """Long table: id, feature, vector; null vectors are left out."""
    long = F.inline(F.array(*[F.struct(F.lit(name).alias("feature"), c.cast("array<float>").alias("vector")) for name, c in parts.items()]))
    return df.select(F.col(id_col).alias("id"), long).where(F.col("vector").isNotNull())


def provenance(found: DataFrame) -> DataFrame:
    """src, dst, the features that found dst, the best similarity."""
    return found.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features"), F.max("sim").alias("sim"))
