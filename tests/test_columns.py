"""Similarities of columns: odd vectors, several passes, and a table that expressions by pair were too slow for."""

import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lattica import catalog
from lattica.operators import pairs as pr

#: Query and vectors of a table whose pairs took several times SECONDS when each was an expression.
TIMED, SECONDS = [("p2_content_to_columns", 10_000), ("p3_columns_to_columns", 10_000)], 15
QUERIES = [name for name, _ in TIMED]


def embeddings(folder, ids, vectors):
    vectors = pa.array([None if v is None else np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()), from_pandas=False)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": vectors, "label": pa.array([0] * len(vectors), pa.int32())}), folder / "embeddings.parquet")


def odd(n=12):
    """Vectors with all-zero columns, with an infinite number, with NaN, without numbers, equal, opposite and of no id."""
    v = list(np.random.default_rng(5).normal(size=(n, 4, 16)))
    v[0][0], v[1][[0, 2]], v[2][:], v[3][2], v[4][1][3], v[5][2][7] = 0, 0, 0, 0, np.inf, np.nan
    v += [v[7], -v[7], np.eye(64)[:4].reshape(4, 4, 16).sum(1).repeat(4, 0)[:4]]
    ids = [100, 200, 300, -100, 5, 6, 0, 7, 8, 9, 10, 400, 500, 600, 11, 700, 12, None]
    return ids, [x.ravel() for x in v] + [None, None, v[7].ravel()]


def rows(found):
    return {(a, b): repr(float("nan") if s is not None and s != s else s) for a, b, s in found}


@pytest.mark.parametrize("name", QUERIES)
def test_odd_vectors_equal_the_sql(spark, tmp_path, name):
    embeddings(tmp_path, *odd())
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want, got = duck.execute(catalog.oracle_sql()[name]).fetchall(), catalog.queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == 9 * 16 and rows(got) == rows(want)


@pytest.mark.parametrize("content", [False, True])
def test_passes_tasks_and_blocks_make_no_difference(spark, monkeypatch, content):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(300)] + [(300, None)], "id long, vector array<double>")
    found = lambda: pr.column_similarity(df.where("id % 10 = 0"), df, 2, 4, content)
    whole = rows(found().collect())
    for name, value in (("QUERY_BYTES", 512), ("TASK_PAIRS", 1000), ("MEET", (3, 7))):
        monkeypatch.setattr(pr, name, value)
    assert rows(found().collect()) == whole and len(whole) == 31 * 300 and found().count() == 31 * 300


@pytest.mark.parametrize("content, want", [(True, None), (False, 0.0)])
def test_no_query_and_queries_without_vectors(spark, content, want):
    df = spark.createDataFrame([(1, [1.0] * 8), (2, [2.0] * 8)], "id long, vector array<double>")
    assert pr.column_similarity(df.where("id > 5"), df, 2, 4, content).collect() == []
    none = spark.createDataFrame([(7, None)], "id long, vector array<double>")
    assert [tuple(r) for r in pr.column_similarity(none, df, 2, 4, content).orderBy("b").collect()] == [(7, 1, want), (7, 2, want)]


def test_vectors_of_another_length_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0] * 4), (1, [1.0] * 12)], "id long, vector array<double>")
    with pytest.raises(Exception, match="2 x 4 numbers"):
        pr.column_similarity(df, df, 2, 4, True).collect()


@pytest.mark.parametrize("name, n", TIMED)
def test_all_pairs_of_a_larger_table_in_time(spark, tmp_path, name, n):
    embeddings(tmp_path, range(n), np.random.default_rng(7).normal(size=(n, 64)))
    start = time.time()
    found = catalog.queries()[name](spark, str(tmp_path)).selectExpr("count(*) AS n", "count(DISTINCT a) AS asked", "sum(similarity) / count(*) AS mean").first()
    assert (found.n, found.asked) == (n // 100 * (n - 1), n // 100) and 0 < found.mean < 1
    assert time.time() - start < SECONDS
