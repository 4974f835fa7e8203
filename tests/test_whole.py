"""Queries over whole tables: every row and all of a text counts."""

from collections import deque

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica import catalog
from lattica.operators import graph as g
from lattica.operators import pairs as pr

SF = "/root/testdata/sf0.001"


def depths(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in near:
        seen, todo = {start: 0}, deque([start])
        while todo:
            x = todo.popleft()
            for y in near[x] - seen.keys():
                seen[y] = seen[x] + 1
                todo.append(y)
        out[start] = max(seen.values())
    return out


@pytest.mark.parametrize("limit", [4_000_000, 0])
def test_eccentricities_of_a_path_and_a_triangle(spark, limit):
    edges = [(i, i + 1) for i in range(57, 63)] + [(200, 201), (201, 202), (200, 202), (5, 5)]
    got = {r.id: r.depth for r in g.eccentricities(spark.createDataFrame(edges, "src long, dst long"), limit).collect()}
    assert got == depths(e for e in edges if e[0] != e[1]) and max(got.values()) == 6


def test_eccentricities_beyond_one_block_of_searches(spark):
    r = np.random.default_rng(7)
    edges = [(int(a) * 3, int(b) * 3) for a, b in r.integers(0, 1500, (1700, 2)) if a != b]
    got = {x.id: x.depth for x in g.eccentricities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == depths(edges)


def test_diameter_counts_all_nodes(spark):
    from lattica.plans.graph_queries import _edges

    want = max(depths([tuple(e) for e in _edges(spark, SF).select("src", "dst").collect()]).values())
    assert catalog.queries()["g5_diameter"](spark, SF).first().longest == want


def greedy(left, right):
    free, out = list(range(len(right))), []
    for i, a in enumerate(left):
        best = max(free, key=lambda j: (pr.similarity(a, right[j]), -j), default=None)
        if best is not None and pr.similarity(a, right[best]) >= 0.75:
            free.remove(best)
            out.append((i, best))
    return out


names = st.lists(st.text("abcé_ .", max_size=6), max_size=25)


@given(names, names)
@settings(max_examples=300, deadline=None)
def test_greedy_matches_equal_the_rule(left, right):
    assert pr.greedy_matches(left, right) == greedy(left, right)


def test_names_behind_the_prefix_match(spark, tmp_path):
    long = " ".join(["und"] * 200)
    texts = [long + " berlin madrid", "x " * 300 + "berlin madrid", None]
    pd.DataFrame({"doc_id": [1, 2, 3], "text": texts}).to_parquet(tmp_path / "documents.parquet")
    first = lambda name: {(r.a, r.b): r for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
    assert {k: r.matches for k, r in first("j16_fuzzy_entity_matches").items()} == {(1, 2): 2, (2, 3): 0}
    assert first("j20_equal_names")[1, 2].matches == 2
    assert first("j19_first_matches")[1, 2][2:] == (2, 0)


def documents(folder, n):
    pd.DataFrame({"doc_id": range(1, n + 1), "text": [("the " if i % 3 else "no ") * (i % 7 + 1) for i in range(1, n + 1)]}).to_parquet(folder / "documents.parquet")


def test_relevance_is_judged_for_ids_of_any_ending(spark, tmp_path):
    documents(tmp_path, 9)
    got = {r.id: (r.kept, r.kept_on_failure) for r in catalog.queries()["q7_relevance_filter"](spark, str(tmp_path)).collect()}
    assert got == {i: (i % 3 > 0, True) for i in range(1, 10)}


def test_several_containers_of_each_kind_are_read(spark, tmp_path):
    documents(tmp_path, 900)
    got = [r.source for r in catalog.queries()["s5_json_containers"](spark, str(tmp_path)).collect()]
    assert len(got) == 900 and {f"d{i}" for i in range(2, 901, 2)} <= set(got) and got.count("item_0") == 6
