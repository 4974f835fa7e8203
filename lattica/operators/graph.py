"""Graphs as edge tables: components, paths, hops, clustering, communities, typed traversals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stored(df: DataFrame) -> str:
    """Writes df as a table in the folder of spark.checkpoint.dir, or in a checkpoint folder of its own where none is set; returns its path."""
    spark = df.sparkSession
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lattica-"))
        base = sc.getCheckpointDir()
    path = f"{base.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, which cuts lineage and outlives lost executors."""
    return df.sparkSession.read.parquet(_stored(df))


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst in both directions, without loops and repeats."""
    e = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (least id): least label of the neighbours, then that label's label, until nothing changes."""
    both = settled(both_ways(edges))
    labels = settled(nodes.select("id").distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.id == near.src, "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("via"))
        up = labels.select(F.col("id").alias("via"), F.col("component").alias("above"))
        stepped = settled(hooked.join(up, "via", "left").select("id", "was", F.least("via", F.coalesce("above", "via")).alias("component")))
        if stepped.where("component <> was").isEmpty():
            return stepped.select("id", "component")
        labels = stepped.select("id", "component")


def _searched(both: DataFrame, start: DataFrame, step: Callable[[DataFrame, int], DataFrame], max_depth: int | None = None) -> DataFrame:
    """All levels of a breadth-first search from start (origin, id, ..) over edges in both directions, each written once.

    A neighbour of a level is in that level, the one before or the next, so only these two are looked through for known nodes.
    """
    read, paths, before, depth = both.sparkSession.read, [_stored(start)], None, 0
    front = read.parquet(paths[0])
    while max_depth is None or depth < max_depth:
        depth += 1
        known = front if before is None else front.unionByName(before)
        path = _stored(step(front, depth).join(known.select("origin", "id"), ["origin", "id"], "left_anti").select(*start.columns))
        before, front = front, read.parquet(path)
        if front.isEmpty():
            break
        paths.append(path)
    return read.parquet(*paths)


def levels(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """origin, id, depth: unweighted distance from each start (column origin)."""
    both = settled(both_ways(edges))

    def step(front: DataFrame, depth: int) -> DataFrame:
        return front.join(both, front.id == both.src).select("origin", F.col("dst").alias("id")).distinct().withColumn("depth", F.lit(depth))

    return _searched(both, starts.select("origin", F.col("origin").alias("id"), F.lit(0).alias("depth")), step, max_depth)


def farthest(sources: np.ndarray, starts: np.ndarray, order: np.ndarray, width: int = 512) -> np.ndarray:
    """Depth of the farthest reached node from each source, a node's number; node i's neighbours are order[starts[i] : starts[i + 1]], one at least.

    Up to `width` searches run at once, each as one bit of a node's row.
    """
    depths = np.zeros(len(sources), dtype=np.int64)
    for at in range(0, len(sources), width):
        part = sources[at : at + width]
        bit = np.arange(len(part))
        front = np.zeros((len(starts) - 1, (len(part) + 63) // 64), dtype=np.uint64)
        np.bitwise_or.at(front, (part, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        seen, depth = front.copy(), 0
        while True:
            depth += 1
            front = np.bitwise_or.reduceat(front[order], starts[:-1], axis=0) & ~seen
            some = np.bitwise_or.reduce(front, axis=0)
            if not some.any():
                break
            seen |= front
            live = (some[bit // 64] >> (bit % 64).astype(np.uint64)) & np.uint64(1)
            depths[at : at + width][live.astype(bool)] = depth
    return depths


def eccentricities(edges: DataFrame, limit: int = 4_000_000) -> DataFrame:
    """id, depth: distance of the farthest node of its component, for every node of the edges.

    Up to `limit` directed edges each task holds the whole graph as arrays; beyond, levels() writes all pairs.
    """
    both = settled(both_ways(edges))
    ids = both.select(F.col("src").alias("origin")).distinct()
    if both.count() > limit:
        return levels(edges, ids).groupBy(F.col("origin").alias("id")).agg(F.max("depth").cast("long").alias("depth"))
    pairs = both.toArrow()
    src, dst = (pairs[c].to_numpy() for c in ("src", "dst"))
    nodes, number = np.unique(src, return_inverse=True)
    by = np.argsort(number, kind="stable")
    starts = np.searchsorted(number[by], np.arange(len(nodes) + 1))
    held = edges.sparkSession.sparkContext.broadcast((nodes, starts, np.searchsorted(nodes, dst)[by]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, starts, order = held.value
        for b in batches:
            yield pd.DataFrame({"id": b["origin"], "depth": farthest(np.searchsorted(nodes, b["origin"].to_numpy()), starts, order)})

    tasks = max(1, min(len(nodes) // 512, 4 * edges.sparkSession.sparkContext.defaultParallelism))
    return ids.repartition(tasks).mapInPandas(search, "id long, depth long")


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """origin, target, depth, path: the lexicographically least shortest path of each pair; a pair without one is left out."""
    both = settled(both_ways(edges))

    def step(front: DataFrame, depth: int) -> DataFrame:
        near = front.join(both, front.id == both.src).groupBy("origin", F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        return near.select("origin", "id", F.concat("path", F.array("id")).alias("path"), F.lit(depth).alias("depth"))

    start = pairs.select("origin").distinct().select("origin", F.col("origin").alias("id"), F.array("origin").alias("path"), F.lit(0).alias("depth"))
    return pairs.join(_searched(both, start, step).withColumnRenamed("id", "target"), ["origin", "target"]).select("origin", "target", "depth", "path")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """id, triangles. Edges point from the node of lower degree, so a hub lists few neighbours."""
    e = both_ways(edges)
    d = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    ranked = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    out = settled(ranked.where(F.struct("ds", "src") < F.struct("dd", "dst")).select("src", "dst"))
    two = out.alias("a").join(out.alias("b"), F.col("a.src") == F.col("b.src")).where(F.col("a.dst") != F.col("b.dst")).select(F.col("a.src").alias("x"), F.col("a.dst").alias("y"), F.col("b.dst").alias("z"))
    closed = two.join(out.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    return closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, coefficient (0 below two neighbours)."""
    d = degrees(edges).join(triangles(edges), "id", "left").na.fill(0, ["triangles"])
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return d.select("id", "degree", "triangles", F.when(pairs > 0, F.col("triangles") / F.when(pairs > 0, pairs)).otherwise(0.0).alias("coefficient"))


def communities(edges: DataFrame, rounds: int = 8, passes: int = 3) -> DataFrame:
    """id, community (its least id): moves by gain of modularity, split into connected pieces, repeated on the graph of the pieces.

    In a round the nodes whose turn a hash gives move at once, each to the neighbouring community of greatest gain, ties to the least;
    rounds end when no node gains. Pieces of a community that hang together become the nodes of the next pass, whose first labels are
    the communities that they came from, so a badly connected community can come apart. The labels of the pass of the greatest
    modularity are kept, so that further passes never make it worse.
    """
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where(F.col("src") != F.col("dst"))
    e = settled(e.groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    piece = settled(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("piece", F.col("id")))
    level, first, best, found = e, None, -2.0, None
    for _ in range(passes):
        moved = settled(_moved(level, first, rounds))
        labels = settled(piece.join(moved.withColumnRenamed("id", "piece"), "piece").select("id", "community"))
        value = modularity(e, labels).first().modularity
        if value is None or value <= best + 1e-9:
            break
        best, found = value, labels
        ends = [moved.select(F.col("id").alias(end), F.col("community").alias(f"_{end}")) for end in ("src", "dst")]
        inside = level.join(ends[0], "src").join(ends[1], "dst").where("_src = _dst").select("src", "dst")
        joined = components(moved, inside).withColumnRenamed("component", "to")
        first = settled(joined.join(moved, "id").groupBy(F.col("to").alias("id")).agg(F.min("community").alias("community")))
        piece = settled(piece.join(joined.withColumnRenamed("id", "piece"), "piece").select("id", F.col("to").alias("piece")))
        named = [joined.select(F.col("id").alias(end), F.col("to").alias(f"_{end}")) for end in ("src", "dst")]
        both = level.join(named[0], "src").join(named[1], "dst")
        level = settled(both.groupBy(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    if found is None:
        return piece.select("id", F.col("id").alias("community"))
    return found.join(found.groupBy("community").agg(F.min("id").alias("least")), "community").select("id", F.col("least").alias("community"))


def _moved(edges: DataFrame, first: DataFrame | None, rounds: int) -> DataFrame:
    """id, community after rounds of moves by gain of modularity; edges are undirected, once each, loops allowed."""
    ends = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))  # a loop counts twice, as in a degree
    strength = settled(ends.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
    both = settled(ends.where("src <> dst"))
    total = strength.agg(F.sum("k").alias("m2")).first().m2 or 1.0
    labels = strength.select("id", F.col("id").alias("community")) if first is None else strength.select("id").join(first, "id")
    labels = settled(labels)
    for i in range(rounds):
        known = labels.join(strength, "id")
        sums = known.groupBy("community").agg(F.sum("k").alias("in"))
        links = both.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        own = known.select("id", "k", F.col("community").alias("old"))
        stay = own.select("id", F.col("old").alias("community"), F.lit(0.0).alias("w"))
        choices = links.unionByName(stay).groupBy("id", "community").agg(F.sum("w").alias("w")).join(own, "id").join(sums, "community")
        others = F.col("in") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * others / total, 9)
        top = choices.groupBy("id", "old").agg(F.max_by(F.struct("community"), F.struct(gain, F.col("community") == F.col("old"), -F.col("community"))).alias("to"), F.max(gain).alias("g"))
        turn = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0
        stepped = settled(top.select("id", F.when(turn, F.col("to.community")).otherwise(F.col("old")).alias("community"), (F.col("to.community") != F.col("old")).alias("open")))
        labels = stepped.select("id", "community")
        if stepped.where("open").isEmpty():
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community) under edge weights."""
    e = edges.select("src", "dst", "weight")
    total = e.agg(F.sum("weight").alias("m"))
    by = labels.select("id", "community")
    inside = e.join(by.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(by.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    strength = e.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("k")).join(by, "id").groupBy("community").agg(F.sum("k").alias("k"))
    terms = strength.join(inside, "community", "left").na.fill(0.0, ["inside"]).crossJoin(F.broadcast(total))  # total is one row
    return terms.agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("modularity"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def rejected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id").distinct()
    known = edges.withColumn("_n", F.lit(1)).join(ids.select(F.col("id").alias("src"), F.lit(1).alias("_s")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("_d")), "dst", "left")
    return known.where(F.col("_s").isNull() | F.col("_d").isNull()).select(*edges.columns)


def one_hop(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id: neighbours of seeds (keys, id) that are no seeds of the same keys."""
    near = seeds.join(both_ways(edges), seeds.id == F.col("src")).select(*keys, F.col("dst").alias("id")).distinct()
    return near.join(seeds.select(*keys, "id"), [*keys, "id"], "left_anti")
