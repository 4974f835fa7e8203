"""Evaluation of ranked lists against gold sets, comparison of runs, and statistics of two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the candidate policies and buckets.
FEW, MANY, STRICT_FEW, TOLERANCE = 10, 500, 20, 1e-9


def judged(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked (query, id, rank) with good: whether the id is in the query's gold (query, id)."""
    marks = gold.select("query", "id").distinct().withColumn("_g", F.lit(1))
    return ranked.join(marks, ["query", "id"], "left").withColumn("good", F.col("_g").isNotNull()).drop("_g")


def gold_sizes(gold: DataFrame) -> DataFrame:
    return gold.groupBy("query").agg(F.countDistinct("id").alias("n_gold"))


def metrics(ranked: DataFrame, gold: DataFrame, k: int, distinct_hits: bool = False) -> DataFrame:
    """query, hit, recall, mrr, mrr_k of queries with gold. A gold id that is listed twice counts twice unless distinct_hits."""
    j = judged(ranked, gold)
    inside = F.col("good") & (F.col("rank") <= k)
    hits = F.countDistinct(F.when(inside, F.col("id"))) if distinct_hits else F.count_if(inside)
    per = j.groupBy("query").agg(hits.alias("_h"), F.min(F.when(F.col("good"), F.col("rank"))).alias("_r"))
    rows = gold_sizes(gold).join(per, "query", "left")
    first = F.col("_r")
    return rows.select(
        "query", F.coalesce((F.col("_h") > 0).cast("int"), F.lit(0)).alias("hit"), (F.coalesce("_h", F.lit(0)) / F.col("n_gold")).alias("recall"),
        F.coalesce(1 / first, F.lit(0.0)).alias("mrr"), F.coalesce(F.when(first <= k, 1 / first), F.lit(0.0)).alias("mrr_k"),
    )


def first_gold(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query, first: rank of the first gold id, null if none is listed; queries with gold only."""
    found = judged(ranked, gold).where("good").groupBy("query").agg(F.min("rank").alias("first"))
    return gold.select("query").distinct().join(found, "query", "left")


def accuracy_curve(ranked: DataFrame, gold: DataFrame, depth: int) -> DataFrame:
    """k, accuracy for k = 1..depth: share of queries with gold among the first k. One pass: ranks are counted, then summed up."""
    firsts = first_gold(ranked, gold)
    ks = firsts.sparkSession.range(1, depth + 1).select(F.col("id").alias("k"))
    n = firsts.agg(F.count(F.lit(1)).alias("n"))
    counts = firsts.where(F.col("first") <= depth).groupBy(F.col("first").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    rows = ks.join(counts, "k", "left").crossJoin(F.broadcast(n))
    running = F.sum(F.coalesce("c", F.lit(0))).over(W.partitionBy("n").orderBy("k"))
    return rows.select("k", (running / F.col("n")).alias("accuracy"))


def candidate_policy(agent: Column, top: Column, few: int = FEW, many: int = MANY) -> Column:
    """No agent ids: none; few: theirs, in order; some: the top list's ids that are also theirs; many: the top list."""
    n = F.size(agent)
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < few, agent).when(n < many, F.array_intersect(top, agent)).otherwise(top)


def strict_policy(agent: Column, top: Column, few: int = STRICT_FEW) -> Column:
    """Under `few` agent ids: theirs; else the common ids in the top list's order, or the top list if there are none."""
    common = F.array_intersect(top, agent)
    return F.when(F.size(agent) < few, agent).when(F.size(common) > 0, common).otherwise(top)


def bucket(n: Column) -> Column:
    return F.when(n < FEW, "<10").when(n < MANY, "10-499").otherwise(">=500")


def scenario(graph: Column, csv: Column) -> Column:
    return F.when(graph & csv, "both_win").when(graph, "graph_wins").when(csv, "csv_wins").otherwise("both_lose")


def group_comparison(df: DataFrame, value: str, flag: str) -> DataFrame:
    """One row: sizes, means, medians, Mann-Whitney U, ROC AUC, the best Youden threshold, the best F1 and average precision of value for flag.

    Rows are counted by value first, so windows run over distinct values only.
    """
    v = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(flag) == 1).alias("pos"), F.count_if(F.col(flag) == 0).alias("neg"))
    total = v.agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    up = W.partitionBy("n1").orderBy(F.desc("v"))
    rows = v.crossJoin(F.broadcast(total)).withColumns({"tp": F.sum("pos").over(up), "fp": F.sum("neg").over(up)})
    below = F.col("n0") - F.col("fp")  # negatives under this value
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("n1")
    youden = recall - F.col("fp") / F.col("n0")
    return rows.agg(
        F.first("n1").alias("n_pos"), F.first("n0").alias("n_neg"), F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))).alias("u"),
        (F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))) / (F.first("n1") * F.first("n0"))).alias("auc"),
        F.max(youden).alias("youden"), F.max_by("v", F.struct(F.round(youden, 9), "v")).alias("threshold"),
        F.max(2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("n1"))).alias("best_f1"), (F.sum(precision * F.col("pos")) / F.first("n1")).alias("average_precision"),
        (F.sum(F.col("v") * F.col("pos")) / F.first("n1")).alias("mean_pos"), (F.sum(F.col("v") * F.col("neg")) / F.first("n0")).alias("mean_neg"),
    )
