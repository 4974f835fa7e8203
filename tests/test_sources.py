"""Folders, file lists, typed CSV, chunk files, column descriptions, extraction plug-ins and communities."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import extraction as ex
from lattica.operators import graph as g
from lattica.sources import readers as rd


def test_sources_by_ending(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, body in {"a b.txt": "one", "T.CSV": "x\n1\n", "c.md": "no", "deep/d.txt": "no", "e.txt": ""}.items():
        (tmp_path / "in" / name).write_text(body)
    (tmp_path / "f.txt").write_text("two")
    got = rd.sources(spark, [f"file://{tmp_path}/in", str(tmp_path / "f.txt"), str(tmp_path / "none.txt")]).collect()
    assert sorted((r.kind, r.content) for r in got) == [("document", "one"), ("document", "two"), ("table", "x\n1\n")]
    assert rd.sources(spark, [str(tmp_path / "none")]).count() == 0


def test_typed_csv_by_header(spark, tmp_path):
    (tmp_path / "a 1.csv").write_text('id,name\n1,"x\n""y"", z"\n2,\n')
    (tmp_path / "b.csv").write_text("id,name\r\n3,w\r\n")
    (tmp_path / "c.csv").write_text("when,value\n2024-01-02 03:04:05,1.5\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("only,these\n")
    found = rd.csv_tables(spark, [str(tmp_path), str(tmp_path / "none")])
    assert sorted(found) == ["id,name", "only,these", "when,value"]
    assert sorted((r.id, r.name) for r in found["id,name"].collect()) == [(1, 'x\n"y", z'), (2, None), (3, "w")]
    assert dict(found["when,value"].dtypes) == {"when": "timestamp", "value": "double", "path": "string"}
    assert found["only,these"].count() == 0
    assert rd.csv_tables(spark, [str(tmp_path / "none")]) == {}


def test_chunk_files_of_one_and_of_many(spark, tmp_path):
    for name, body in {"a.json": '{"chunk_id": "1",\n "content": "x"}', "b.json": '[{"chunk_id": "2"}, {"content": "no id"}]', "c.json": '{"chunk_id":', "d.txt": '{"chunk_id": "9"}'}.items():
        (tmp_path / name).write_text(body)
    got = rd.chunk_files(spark, str(tmp_path), "chunk_id string, content string").collect()
    assert sorted((r.chunk_id, r.content or "") for r in got) == [("1", "x"), ("2", "")]


@pytest.mark.parametrize(
    "raw,headers,want",
    [('{"b": "2", "c": "3"}', ["a", "b"], ["", "2"]), ('["u", "v"]', ["a"], ["u", "v"]), (None, ["a"], []), ("7", None, []), ('{"a": "1"}', None, [])],
)
def test_column_descriptions(spark, raw, headers, want):
    df = spark.createDataFrame([(raw, headers)], "raw string, headers array<string>")
    assert df.select(rd.column_descriptions(F.col("raw"), F.col("headers")).alias("d")).first().d == want


def test_extraction_in_groups_that_may_fail(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError
            return [([t], []) for t in texts]

        return model

    df = spark.createDataFrame([(1, "New York in 1999. New York"), (2, None), (3, "")], "id long, text string").coalesce(1)
    assert [(r.entities, r.events) for r in ex.extracted(df, "text").orderBy("id").collect()] == [(["New York"], ["1999"]), ([], []), ([], [])]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "bad"), (4, "c")], "id long, text string").coalesce(1).withColumn("events", F.lit("old"))
    assert [(r.entities, r.events) for r in ex.extracted(df, "text", load, 2).orderBy("id").collect()] == [(["a"], []), (["b"], []), ([], []), ([], [])]


def test_generated_query_gives_up(spark):
    errors = []

    def generate(question, error):
        errors.append(error)
        return "SELECT nothing FROM {t}"

    with pytest.raises(ValueError, match="2 attempts"):
        ex.generated(spark, "?", generate, {"t": spark.range(1)}, attempts=2)
    assert errors[0] is None and "nothing" in errors[1]


def test_communities_of_a_ring_of_cliques(spark):
    edges = [(a, b, 1.0) for i in range(0, 20, 5) for a in range(i, i + 5) for b in range(a + 1, i + 5)] + [(i + 4, (i + 5) % 20, 1.0) for i in range(0, 20, 5)]
    e = spark.createDataFrame([*edges, (3, 3, 9.0)], "src long, dst long, weight double")
    labels = g.communities(e)
    assert {r.id: r.community for r in labels.collect()} == {i: i // 5 * 5 for i in range(20)}


def test_communities_of_the_neighbour_graph(spark):
    from lattica.plans.graph_queries import _edges

    e = _edges(spark, "/root/testdata/sf0.001").withColumnRenamed("sim", "weight")
    assert g.modularity(e, g.communities(e)).first().modularity > 0.5
