"""Typed graph: nodes (id, type, name, year), relations (src, dst, relation), traversals and query plans over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.tables import table

Plan = list[dict]


class TypedGraph:
    """Customers place orders, orders contain parts, suppliers supply parts, customers and suppliers sit in nations."""

    def __init__(self, spark, sf_dir: str):
        t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "part", "supplier", "nation")}
        self.spark, self.t = spark, t
        rel = lambda df, s, d, name: df.select(F.col(s).alias("src"), F.col(d).alias("dst")).distinct().withColumn("relation", F.lit(name))
        self.relations = {
            "places": rel(t["orders"], "o_custkey", "o_orderkey", "places"),
            "contains": rel(t["lineitem"], "l_orderkey", "l_partkey", "contains"),
            "supplies": rel(t["lineitem"], "l_suppkey", "l_partkey", "supplies"),
            "sits_in": rel(t["customer"], "c_custkey", "c_nationkey", "sits_in"),
        }

    def step(self, ids: DataFrame, relation: str, reverse: bool = False) -> DataFrame:
        """Distinct nodes one relation away from ids (id)."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        return ids.join(self.relations[relation], F.col("id") == F.col(a)).select(F.col(b).alias("id")).distinct()

    def neighbours(self, seeds: DataFrame, relation: str, reverse: bool = False) -> DataFrame:
        """seed, id for every seed (id)."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        return seeds.join(self.relations[relation], F.col("id") == F.col(a)).select(F.col(a).alias("seed"), F.col(b).alias("other")).distinct().withColumnRenamed("other", "id")


def co_neighbours(relation: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id: other sources that share a target with the seed."""
    s = seeds.select(F.col("id").alias("seed"))
    mine = relation.select(F.col("src").alias("seed"), F.col("dst").alias("via")).join(s, "seed", "left_semi")
    others = relation.select(F.col("src").alias("id"), F.col("dst").alias("via"))
    return mine.join(others, "via").where("id <> seed").select("seed", "id").distinct()


def co_targets(relation: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """seed, id, support: targets shared by at least `least` distinct sources that also have the seed as a target."""
    r = relation.select("src", "dst").distinct()
    holders = r.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("seed"), "src")
    also = holders.join(r, "src").where("dst <> seed").groupBy("seed", F.col("dst").alias("id")).agg(F.countDistinct("src").alias("support"))
    return also.where(F.col("support") >= least)


def matching(df: DataFrame, criteria: dict) -> DataFrame:
    """Rows that meet every criterion: a value, or a dict with min and max (inclusive); a missing value meets none."""
    conditions = []
    for column, want in criteria.items():
        if isinstance(want, dict):
            conditions += [F.col(column) >= want["min"]] if "min" in want else []
            conditions += [F.col(column) <= want["max"]] if "max" in want else []
            conditions.append(F.col(column).isNotNull())
        else:
            conditions.append(F.col(column) == want)
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def intersection(sets: list[DataFrame]) -> DataFrame:
    """Ids in all sets: those that occur in as many as there are."""
    tagged = [s.select("id").distinct().withColumn("_set", F.lit(i)) for i, s in enumerate(sets)]
    return reduce(DataFrame.unionByName, tagged).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(sets)).select("id")


def union(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select("id") for s in sets]).distinct()


def execute(plan: Plan, actions: dict[str, Callable[..., DataFrame]]) -> tuple[DataFrame | None, list[str]]:
    """The union of all steps' ids (0 is an id like any other; null none) and the steps' errors; unknown actions don't stop the plan."""
    found, errors = [], []
    for i, s in enumerate(plan):
        action = actions.get(s["action"])
        if action is None:
            errors.append(f"step {i + 1}: unknown action {s['action']}")
        else:
            found.append(action(**s.get("params", {})).select("id").where(F.col("id").isNotNull()))
    return (union(found) if found else None), errors


def plan_of(question: str) -> Plan:
    """Steps by keywords of the question: years (whole numbers from 1900 to 2099) give a range, names of relations a traversal."""
    import re

    years = [int(y) for y in re.findall(r"\b(?:19|20)\d\d\b", question)]
    plan: Plan = []
    if years:
        plan.append({"action": "orders_in_years", "params": {"first": min(years), "last": max(years)}})
    low = question.lower()
    for word, action in (("customer", "customers_of_nation"), ("part", "parts_of_nation"), ("order", "orders_of_nation")):
        m = re.search(r"\b(?:in|of|from) ([A-Z_0-9]+)\b", question)
        if word in low and m:
            plan.append({"action": action, "params": {"nation": m[1]}})
    return plan
