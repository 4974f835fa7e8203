import pytest
from pyspark.sql import functions as F

from lattica.llm import exact_dedup

ROWS = [(1, "a b", 1), (2, "ab", 2), (3, "a  b", 3), (4, None, 4), (5, " \t", 5), (6, "", 6), (7, "ab c", 7), (8, "AB", 8), (9, "a  b", 9), (10, "x" * 200_000, 10), (11, "x" * 200_000 + "\n", 11), (12, "é b", 12), (12, "é b", 13), (None, "né", 14)]
SCHEMA = "doc_id long, text string, digest int"


def brute(rows):
    groups = {}
    for i, (d, t, _) in enumerate(rows):
        t = t or ""
        groups.setdefault(t.translate(dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))), []).append((-len(t), d is None, d, i))
    return sorted((str(d), str(min(g)[2]), len(g)) for g in groups.values() for _, _, d, _ in g)


def collide(text):
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 0)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, collide])
@pytest.mark.parametrize("per_batch", [None, 1])
def test_equals_brute_force_even_when_digests_collide(spark, digest, per_batch):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = exact_dedup.classes(docs, digest, per_batch).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == brute(ROWS)
    assert sum(r.kept for r in got) == len({(r.keep_id, r.text_sha256) for r in got})


def test_state_carries_over_batches(spark, tmp_path):
    log, ck, out = (str(tmp_path / x) for x in ("log", "ck", "out"))
    spark.createDataFrame([("d", -3, False, 7, "f", 0)], "digest string, neg_chars int, no_id boolean, doc_id long, file string, at long").drop("no_id").write.parquet(log)
    first = exact_dedup.stream_state(spark, log, ck, out, 1).collect()
    spark.createDataFrame([("d", -5, 9, "f", 1), ("e", -1, 8, "f", 2)], "digest string, neg_chars int, doc_id long, file string, at long").write.mode("append").parquet(log)
    second = {r.digest: (r.best.doc_id, r.n) for r in exact_dedup.stream_state(spark, log, ck, out, 1).collect()}
    assert (first[0].best.doc_id, first[0].n) == (7, 1)
    assert second == {"d": (9, 2), "e": (8, 1)}


def test_keep_first_keeps_columns_and_handles_empty(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "5", "7", "8", "11", "12", "None"])
    assert exact_dedup.keep_first(docs.limit(0)).collect() == []
