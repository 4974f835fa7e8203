"""Each pipeline stage against a brute-force version on its own input; the pipeline as a whole."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import decontaminate, quality, simhash, stages
from lattica.llm.common import BATCH_BYTES, table, written

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BLANK = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def brute_quality(spark, rows):
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    return {r.doc_id for r in rows if model.score_texts([r.text or ""])[0] >= quality.THRESHOLD}


def brute_exact(rows):
    best = {}
    for r in rows:
        key = (r.text or "").translate(BLANK)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text or ""), r.doc_id)) if key in best else (-len(r.text or ""), r.doc_id)
    return {d for _, d in best.values()}


def brute_near(rows):
    fps = np.array([simhash.fingerprint(r.text) for r in rows], np.int64).view(np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            if a != b:
                parent[max(a, b, key=lambda x: rows[x].doc_id)] = min(a, b, key=lambda x: rows[x].doc_id)
    return {rows[find(i)].doc_id for i in range(len(rows))}


def brute_clean(spark, rows):
    wins = {w for r in table(spark, SF, "benchmark").collect() for w in decontaminate.windows(r.text)}
    padded = lambda r: b" " + b" ".join(decontaminate.words(r.text)) + b" "
    return {r.doc_id for r in rows if not any(f" {w} ".encode() in padded(r) for w in wins)}


def test_stages_equal_brute_force(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = table(spark, SF, "documents")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, (lambda r: brute_quality(spark, r), brute_exact, brute_near, lambda r: brute_clean(spark, r))):
        rows = docs.collect()
        out = written(stage(spark, docs, SF), name)
        assert out.columns == COLUMNS
        assert {r.doc_id for r in out.collect()} == brute(rows), name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in rows}
        docs = out
    packed = stages.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    total = {}
    for r in packed:
        total[r.shard, r.bin] = total.get((r.shard, r.bin), 0) + r.n_tokens
    assert all(n <= 2048 for (_, b), n in total.items() if b >= 0)


def test_stages_on_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture
def unbounded(spark):
    """The session with Spark's own bound on Arrow batches, put back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    spark.conf.unset(key)
    yield key
    spark.conf.set(key, was)


def test_quality_stage_sends_bounded_batches(spark, unbounded, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("lorem ipsum "), 400).alias("text")).write.parquet(path)  # 19 MB, one task
    most = BATCH_BYTES + 100_000

    def within(texts, score):
        return np.full(len(texts), float(sum(map(len, texts)) <= most))

    monkeypatch.setattr(quality, "fit", lambda *_: quality.Model(0.5))
    monkeypatch.setattr(quality, "by_block", within)
    assert stages.quality(spark, spark.read.parquet(path), SF).count() == 4000


@pytest.mark.parametrize("stage", [stages.quality, stages.near, stages.decontaminate, stages.pack])
def test_python_stages_bound_batches(spark, unbounded, stage):
    empty = table(spark, SF, "documents").limit(0)
    stage(spark, empty, SF)
    assert spark.conf.get(unbounded).rstrip("b") == str(BATCH_BYTES)
    spark.conf.set(unbounded, "1m")
    stage(spark, empty, SF)
    assert spark.conf.get(unbounded) == "1m"
