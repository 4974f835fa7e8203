"""Order-dependent and sequential rules on small fixtures worked out by hand."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import chunking as ch
from lattica.operators import evaluate as ev
from lattica.operators import graph as g
from lattica.operators import knn
from lattica.operators import lexical as lx
from lattica.operators import pairs as pr
from lattica.operators import traversal as tr
from lattica.sources import readers as rd


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("given_,want", [
    (["Hi.", "This sentence is longer than that.", "Ok."], ["Hi. This sentence is longer than that. Ok."]),
    (["Ok."], ["Ok."]), ([], []), (["a.", "b.", "c."], ["a. b. c."]), (["x" * 30, "b.", "c" * 30], ["x" * 30, "b. " + "c" * 30]),
])
def test_short_sentences_merge(spark, given_, want):
    assert one(spark, tx.merged_short_sentences(F.col("s")), s=("array<string>", given_)) == want


def test_breaks_need_a_distance_above_the_percentile(spark):
    s = spark.createDataFrame([(1, i, f"s{i}") for i in range(6)] + [(2, i, f"t{i}") for i in range(4)], "doc_id long, pos int, sentence string")
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.1, 0.1, 0.1, 0.1, 0.9])] + [(2, i, 0.5) for i in range(3)], "doc_id long, pos int, distance double")
    got = {(r.doc_id, r.chunk): r.content for r in ch.semantic_chunks(s, d).collect()}
    assert got == {(1, 0): "s0 s1 s2 s3 s4", (1, 1): "s5", (2, 0): "t0 t1 t2 t3"}


@pytest.mark.parametrize("n,want", [(9, [9]), (10, [10]), (14, [14]), (15, [10, 5]), (24, [10, 14])])
def test_row_blocks(spark, n, want):
    got = ch.row_blocks(spark.range(n), ["id"]).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in got] == want


def test_keyword_ties_keep_first_occurrence(spark):
    d = spark.createDataFrame([(1, "bb aaa ccc aaa bbb ccc")], "doc_id long, text string")
    assert [r.keyword for r in ch.keywords(d).orderBy("rank").collect()] == ["aaa", "ccc", "bbb"]


def test_merge_and_resize_rules():
    flat = lambda chunks: [s for c in chunks for s in c]
    chunks = [["a b."], ["a b.", "a b.", "a c."], ["x y."], ["x y.", "x z.", "x y."]]
    done = ch.merged_to_fixpoint(chunks)
    assert done == [["a b.", "a b.", "a b.", "a c."], ["x y.", "x y.", "x z.", "x y."]]
    long = [[f"w{i}." for i in range(45)], ["tail."]]
    done = ch.resized(long)
    assert flat(done) == flat(long) and max(map(len, done)) <= 23


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a b.", "c d.", "e f."]), min_size=1, max_size=9), max_size=12))
def test_rechunking_keeps_all_sentences(chunks):
    flat = [s for c in chunks for s in c]
    for rule in (ch.merged_to_fixpoint, ch.resized):
        done = rule(chunks)
        assert [s for c in done for s in c] == flat
    assert len(ch.merged_to_fixpoint(chunks)) <= 1 or min(map(len, ch.merged_to_fixpoint(chunks))) >= 3


def test_greedy_matching_takes_left_first():
    assert pr.greedy_matches(["anna smith", "ana smith"], ["anna smith"]) == [(0, 0)]
    assert pr.greedy_matches(["zzz"], ["anna"]) == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_name_similarity_is_symmetric_and_bounded(a, b):
    assert pr.similarity(a, b) == pr.similarity(b, a)
    assert 0 <= pr.similarity(a, b) <= 1 + 1e-12


@pytest.mark.parametrize("distances,kept", [([0, 0, 0.5, 0.51], 2), ([0.3] * 5, 5), ([0.5], 1), ([0, 1.0], 1)])
def test_adaptive_cut(spark, distances, kept):
    rows = [(1, i, i + 1, float(d)) for i, d in enumerate(distances)]
    f = spark.createDataFrame(rows, "src long, dst long, rank int, distance double")
    assert knn.adaptive_cut(f, ["src"]).count() == kept


def test_hybrid_fallbacks(spark):
    near = spark.createDataFrame([(q, i, i / 10, i) for q in (1, 2, 3) for i in range(1, 6)], "query long, id long, distance double, rank long")
    lexical = spark.createDataFrame(
        [(1, i, float(9 - i), i) for i in range(1, 6)] + [(2, 6 - i, float(9 - i), i) for i in range(1, 6)] + [(3, 100 + i, float(9 - i), i) for i in range(1, 6)], "query long, id long, score double, rank long"
    )
    got = {}
    for r in lx.common_or_fallback(near, lexical, 4).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert got == {1: {1}, 2: {1, 2, 3, 4, 5}, 3: {1, 2, 101, 102}}


def test_frequent_terms_have_negative_idf(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "c"])], "id long, tokens array<string>")
    idf = {r.term: r.idf for r in lx.LexicalIndex(docs).idf().collect()}
    assert idf["a"] < 0 < idf["b"]
    assert abs(idf["a"] - (np.log(0.5) - np.log(3.5))) < 1e-12


@pytest.mark.parametrize("n,want", [(0, 0), (9, 9), (10, 10), (499, 100), (500, 100)])
def test_candidate_policy(spark, n, want):
    got = one(spark, ev.candidate_policy(F.col("a"), F.col("t")), a=("array<bigint>", list(range(n))), t=("array<bigint>", list(range(100))))
    assert len(got) == want


@pytest.mark.parametrize("s,want", [("['a','b']", ["a", "b"]), ("\"['a']\"", ["a"]), ("a", ["a"]), ("", []), (None, []), ("[1, 2]", ["1", "2"])])
def test_list_literals(spark, s, want):
    assert one(spark, tx.list_literal("s"), s=("string", s)) == want


def test_paths_components_and_levels(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 3), (3, 2), (5, 6)], "src long, dst long")
    pairs = spark.createDataFrame([(0, 2), (0, 6)], "origin long, target long")
    got = g.shortest_paths(edges, pairs).collect()
    assert [(r.origin, r.target, r.depth, r.path) for r in got] == [(0, 2, 2, [0, 1, 2])]
    assert {r.id: r.component for r in g.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}


def test_communities_beat_singletons(spark):
    clique = lambda xs: [(a, b, 1.0) for a in xs for b in xs if a < b]
    e = spark.createDataFrame(clique(range(5)) + clique(range(5, 10)) + [(4, 5, 0.1)], "src long, dst long, weight double")
    labels = g.communities(e)
    assert len({r.community for r in labels.collect()}) == 2
    assert g.modularity(e, labels).first().modularity > 0.4


def test_indexed_search_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 10 = 0")
    exact = {(r.src, r.dst) for r in knn.search(q, v, 10).collect()}
    found = {(r.src, r.dst) for r in knn.InvertedFile(v, n_cells=8).search(q, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    every = knn.InvertedFile(v, n_cells=4, probe=4).search(q, 10).collect()
    assert {(r.src, r.dst) for r in every} == exact


def test_plans_union_steps_and_report_errors(spark):
    ids = spark.createDataFrame([(0,), (None,), (3,)], "id long")
    found, errors = tr.execute([{"action": "a"}, {"action": "none"}, {"action": "a"}], {"a": lambda: ids})
    assert {r.id for r in found.collect()} == {0, 3} and len(errors) == 1
    assert tr.plan_of("orders between 1994 and 2001")[0]["params"] == {"first": 1994, "last": 2001}


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One. Two.")
    (tmp_path / "t.csv").write_text('id,name\n1,"x, y"\n2,z\n')
    (tmp_path / "j.json").write_text('{"items": [{"id": "p", "content": "c"}, {"text": "d"}]}')
    (tmp_path / "l.json").write_text('[{"title": "q", "text": "e"}]')
    (tmp_path / "bad.json").write_text("{nope")
    assert [r.content for r in rd.text_files(spark, str(tmp_path)).collect()] == ["One. Two."]
    assert [r.row for r in rd.table_rows(spark, str(tmp_path)).orderBy("rn").collect()] == [{"id": "1", "name": "x, y"}, {"id": "2", "name": "z"}]
    got = rd.json_entries(spark, [str(tmp_path / f) for f in ("j.json", "l.json", "bad.json")]).collect()
    assert {(r.source, r.content) for r in got} == {("p", "c"), ("item_1", "d"), ("q", "e")}


def test_edges_with_unknown_ends_are_dropped(spark):
    dump = spark.createDataFrame([([[1, 1], [2, 9]], [0, 0])], "edge_index array<array<long>>, edge_types array<int>")
    names = spark.createDataFrame([(0, "author___writes___paper")], "code int, name string")
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert [tuple(r) for r in rd.edge_arrays(dump, names, nodes).collect()] == [(1, 2, "writes")]
