"""SimHash near-duplicates: a Gray-ordered hierarchical index over distinct fingerprints.

Fingerprints within k = 2 bits agree in at least one of three blocks of their bits. Each fingerprint is rotated so that a block
leads, and sorted by Gray rank, which keeps equal leading bits together. Inside such a run the index has one node for each
shared pattern of masked bits at each level; the self-join walks pairs of nodes from the top, adds up the differing masked bits,
and drops a pair of whole groups as soon as the sum exceeds k. Runs that are too long get a second agreeing block (again one of
three in the other bits), so no task needs to hold one hot block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import drop_path, located, scratch, small, without, written

SEED, BITS, K = 42, 64, 2
#: Parameters: bits that one index level adds; candidate node pairs expanded at once; run length from which a run is divided.
LEVEL_BITS, PAIRS_AT_ONCE, LONG_RUN = 7, 1 << 20, 20_000


def fingerprint(text: str | None) -> int:
    """64-bit SimHash (signed) over 3-word shingles of A-Z lower-cased text; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [h(b" ".join(words), SEED)]
    else:
        hashes = [h(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    all_bytes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(all_bytes), 1 << 16):
        ones += np.unpackbits(all_bytes[i : i + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray code; its leading bits depend on the pattern's leading bits alone."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def node_starts(x: np.ndarray, bits: int) -> np.ndarray:
    top = x >> np.uint64(BITS - bits)
    return np.flatnonzero(np.r_[True, top[1:] != top[:-1]]) if len(x) else np.zeros(0, np.int64)


def links(x: np.ndarray, lead: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of distinct, Gray-sorted patterns that agree in their first `lead` bits and differ in at most k others."""
    depth = [*range(lead, BITS, LEVEL_BITS), BITS]
    starts = [node_starts(x, b) for b in depth]
    kids = []  # of each node: its first child and their number, on the next level
    for up, down in zip(starts, starts[1:], strict=False):
        first = np.searchsorted(down, up)
        kids.append((first, np.diff(np.r_[first, len(down)])))
    top = np.arange(len(starts[0]))
    stack = [(0, top, top, np.zeros(len(top), np.int8))]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while stack:
        level, a, b, diff = stack.pop()
        if level == len(kids):
            found_a.append(starts[level][a[a != b]])
            found_b.append(starts[level][b[a != b]])
            continue
        first, count = kids[level]
        single = (a == b) & (np.diff(np.r_[starts[level], len(x)])[a] == 1)
        a, b, diff = a[~single], b[~single], diff[~single]
        n = count[a] * count[b]
        if not len(a):
            continue
        ends = np.cumsum(n)
        if ends[-1] > PAIRS_AT_ONCE and len(a) > 1:
            cut = max(1, min(int(np.searchsorted(ends, PAIRS_AT_ONCE)), len(a) - 1))
            stack += [(level, a[cut:], b[cut:], diff[cut:]), (level, a[:cut], b[:cut], diff[:cut])]
            continue
        pair = np.repeat(np.arange(len(a)), n)
        nth = np.arange(ends[-1]) - np.repeat(ends - n, n)
        ca, cb = first[a[pair]] + nth // count[b[pair]], first[b[pair]] + nth % count[b[pair]]
        mask = np.uint64(((1 << (depth[level + 1] - depth[level])) - 1) << (BITS - depth[level + 1]))
        more = np.bitwise_count((x[starts[level + 1][ca]] ^ x[starts[level + 1][cb]]) & mask).astype(np.int8)
        total = diff[pair] + more
        good = (total <= k) & (ca <= cb)  # a < b puts all children of a first
        stack.append((level + 1, ca[good], cb[good], total[good]))
    return np.concatenate(found_a), np.concatenate(found_b)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _stars(path: int, lead: int, x: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    order = np.argsort(gray_rank(x), kind="stable")
    x, fp = x[order], fp[order]
    a, b = links(x, lead)
    label = roots(len(x), a, b)
    away = np.flatnonzero(label != np.arange(len(x)))
    return pd.DataFrame({"u": fp[away], "v": fp[label[away]]})


def star_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (path, lead, bucket); the last bucket of a batch waits for the next batch."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf[["path", "bucket"]] == pdf[["path", "bucket"]].iloc[-1]).all(axis=1).to_numpy()
        cut = len(pdf) if not last.any() else int(np.argmax(last))
        rest, ready = pdf.iloc[cut:], pdf.iloc[:cut]
        for (path, lead), g in ready.groupby(["path", "lead"]):
            yield _stars(path, int(lead), g["x"].to_numpy(np.int64).view(np.uint64), g["fp"].to_numpy(np.int64))
    if rest is not None and len(rest):
        for (path, lead), g in rest.groupby(["path", "lead"]):
            yield _stars(path, int(lead), g["x"].to_numpy(np.int64).view(np.uint64), g["fp"].to_numpy(np.int64))


def _rotated(x: Column, fixed: int, by: int) -> Column:
    """x with the bits after its first `fixed` rotated left by `by`."""
    width = BITS - fixed
    if by == 0:
        return x
    low_mask = F.lit((1 << width) - 1 if width < 64 else -1).cast("long")
    low = x.bitwiseAND(low_mask)
    turned = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, width - by)).bitwiseAND(low_mask)
    return x.bitwiseAND(F.bitwise_not(low_mask)).bitwiseOR(turned)


def _blocks(fixed: int) -> list[tuple[int, int]]:
    """(start, length) of K + 1 blocks of the bits after the first `fixed`."""
    width, n = BITS - fixed, K + 1
    sizes = [width // n + (i < width % n) for i in range(n)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _under_blocks(rows: DataFrame, fixed: int) -> DataFrame:
    """Each row once for each block of its free bits, with that block brought to the front of them."""
    options = F.array(*[F.struct((F.col("path") * 4 + i + 1).alias("path"), F.lit(fixed + n).alias("lead"), _rotated(F.col("x"), fixed, at).alias("x"), "fp") for i, (at, n) in enumerate(_blocks(fixed))])
    return rows.select(F.explode(options).alias("r")).select("r.*")


def _bucket() -> Column:
    return F.expr("shiftrightunsigned(x, 64 - lead)").alias("bucket")


def linked(fps: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) whose closure is that of all links at K or fewer differing bits."""
    rows = _under_blocks(fps.select(F.lit(0).alias("path"), F.lit(0).alias("lead"), F.col("fp").alias("x"), "fp"), 0)
    done = None
    for _ in range(2):  # after two more blocks at most 2**18 patterns share a bucket
        rows = rows.withColumn("bucket", _bucket())
        hot = rows.groupBy("path", "lead", "bucket").count().where(F.col("count") > long_run).drop("count")
        hot = written(hot, "simhash-long")
        if hot.isEmpty():
            break
        hot = small(hot, 40)
        cold = rows.join(hot, ["path", "lead", "bucket"], "left_anti").drop("bucket")
        done = cold if done is None else done.unionByName(cold)
        busy = rows.join(hot, ["path", "lead", "bucket"], "left_semi").drop("bucket")
        leads = sorted({r.lead for r in hot.select("lead").distinct().collect()})
        parts = [_under_blocks(busy.where(F.col("lead") == lead), lead) for lead in leads]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
    else:
        rows = rows.withColumn("bucket", _bucket())
    rows = rows.drop("bucket")
    rows = (rows if done is None else done.unionByName(rows)).withColumn("bucket", _bucket())
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(n, "path", "bucket").sortWithinPartitions("path", "bucket")
    return sorted_rows.mapInPandas(star_links, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (u, v): least label of the neighbours, then the label's label, until nothing changes. Each round is a written table."""
    spark = edges.sparkSession
    links_path, paths = scratch(spark, "links"), [scratch(spark, "labels")]
    edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().write.parquet(links_path)
    both = spark.read.parquet(links_path)
    both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).select(F.col("u").alias("node"), "root").write.parquet(paths[0])
    while True:
        labels = spark.read.parquet(paths[-1]).select("node", "root")
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels.node == near.u).select("node", F.col("root").alias("was"), F.least("root", "near").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("root").alias("above"))
        paths.append(scratch(spark, "labels"))
        hooked.join(up, "via").select("node", "was", F.least("via", "above").alias("root")).write.parquet(paths[-1])
        drop_path(spark, paths[-2])
        stepped = spark.read.parquet(paths[-1])
        if stepped.where("root <> was").isEmpty():
            drop_path(spark, links_path)
            return stepped.select("node", "root")


def groups(docs: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """One row per row of docs: doc_id, file, at, fp, component_id (least doc_id reachable over links of K or fewer bits), in_group.

    A text without words (null, empty, blank) has fingerprint zero, which links like any other. Texts are read whole at any length,
    one at a time. Repeated rows each get a row and share a component; a tie of ids can't arise, since the least id names the
    component. An empty table gives an empty table. Columns other than doc_id and text aren't read, whatever their names.
    """
    return _groups(located(docs), long_run)


def _groups(located_rows: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    rows = written(located_rows.select("row.doc_id", "file", "at", fingerprints("row.text").alias("fp")), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_same")), "nodes")
    roots_of = components(linked(nodes.select("fp"), long_run))
    member = nodes.join(roots_of, nodes.fp == roots_of.node).select("fp", "least_id", "n_same", "root")
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    in_groups = member.join(least, "root").select("fp", "component_id")
    copies = nodes.where("n_same > 1").select("fp", F.col("least_id").alias("component_id")).join(roots_of.select(F.col("node").alias("fp")), "fp", "left_anti")
    of = small(written(in_groups.unionByName(copies), "groups"), 60)
    return rows.join(of, "fp", "left").select("doc_id", "file", "at", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("component_id").isNotNull().alias("in_group"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the least doc_id (null last), of repeated ids the first stored; columns as given."""
    rows = located(docs)
    grouped = _groups(rows).where("in_group").withColumn("this", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "at"))
    stays = small(written(grouped.groupBy("component_id").agg(F.min("this").alias("first")), "stays"), 200)
    return without(rows, grouped.join(stays, "component_id").where("this <> first").select("file", "at"))
