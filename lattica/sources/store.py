"""Keyed tables: content-addressed cache, upserts, edge loading and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Numbers and texts that stand for a missing property.
MISSING = ("-1", "-1.0", "")


def cache_key(source: Column, content: Column) -> Column:
    return F.concat_ws("_", F.substring(F.md5(source.cast("binary")), 1, 8), F.substring(F.sha2(content.cast("binary"), 256), 1, 16))


def new_content(incoming: DataFrame, cached: DataFrame, key: str = "cache_key") -> DataFrame:
    """Rows whose key isn't cached, one for each key."""
    return incoming.dropDuplicates([key]).join(cached.select(key), key, "left_anti")


def newer_than(cached: DataFrame, moment: str, column: str = "created_at") -> DataFrame:
    return cached.where(F.col(column) > F.lit(moment).cast("timestamp"))


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row for each key: the one of the latest version; an incoming row wins over a current one of equal version. Null properties keep the current value."""
    both = current.withColumn("_s", F.lit(0)).unionByName(incoming.withColumn("_s", F.lit(1)))
    w = W.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), F.desc("_s")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = [c for c in current.columns if c not in key]
    latest = both.select(*key, *[F.first(c, ignorenulls=True).over(w).alias(c) for c in rest], F.row_number().over(W.partitionBy(*key).orderBy(F.col(version).desc_nulls_last(), F.desc("_s"))).alias("_r"))
    return latest.where("_r = 1").select(*current.columns)


def present(c: Column | str) -> Column:
    """Null for values that stand for a missing property."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~col.cast("string").isin(*MISSING), col)


def properties(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """The named columns under their new names, stand-ins for missing values as null."""
    return df.select(*[present(old).alias(new) for old, new in renames.items()])


def oriented(edges: DataFrame, types: DataFrame, source_type: str, target_type: str) -> DataFrame:
    """src, dst, swapped: edges in the direction source_type -> target_type; those that fit only the other way round are turned, unless that edge is there already; the rest are dropped."""
    t = types.select("id", "type")
    e = edges.select("src", "dst").distinct()
    typed = e.join(t.select(F.col("id").alias("src"), F.col("type").alias("ts")), "src").join(t.select(F.col("id").alias("dst"), F.col("type").alias("td")), "dst")
    right = typed.where((F.col("ts") == source_type) & (F.col("td") == target_type)).select("src", "dst", F.lit(False).alias("swapped"))
    turned = typed.where((F.col("ts") == target_type) & (F.col("td") == source_type)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return right.unionByName(turned.join(right.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("swapped", F.lit(True)))


def type_by_range(node: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    """The type whose range (first, last) holds the id."""
    out = F.lit(None).cast("string")
    for kind, (first, last) in ranges.items():
        out = F.when(node.between(first, last), kind).otherwise(out)
    return out


def merged_manifest(parts: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """feature, path of several manifests with features renamed; of equal features the first manifest's stays."""
    rows = None
    for i, (df, renames) in enumerate(parts):
        name = F.col("feature")
        for old, new in renames.items():
            name = F.when(F.col("feature") == old, new).otherwise(name)
        part = df.select(name.alias("feature"), "path", F.lit(i).alias("_p"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("feature").orderBy("_p"))).where("_r = 1").select("feature", "path")
