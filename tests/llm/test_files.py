"""WARC archives and token files: round trips, determinism, edge cases."""

import hashlib
import os

import numpy as np
import pytest

from lattica.llm import tokencount as tc
from lattica.llm import warc

BIG = "<p>" + "é" * 800 + "</p>"
PAGES = [(1, "http://a/ b", BIG, 0), (2, "http://b", BIG, 0), (9, None, BIG, 0), (3, "http://c\r\nX: y", None, 0), (4, "http://d", "", 0), (5, "http://e", "same", 0), (6, "http://f", "same", 0), (None, "http://g", "n" * 2000, 0), (7, "http://h", "n" * 2000, 0), (8, "http://i", "z" * 3_000_000, 0), (8, "http://i", "z" * 3_000_000, 0)]
SCHEMA = "page_id long, url string, html string, shard int"


def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark), folder, shard_bytes=1 << 20, roll_bytes=2000)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(PAGES) and sum(r.n_records for r in manifest.collect()) == len(PAGES)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, url, html, _ in PAGES:
        for r in by[i]:
            b = (html or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
            assert r.payload is None if r.record_type == "revisit" else r.payload == (html or "")
            assert (r.url is None) == (url is None)
    kinds = {i: sorted((r.record_type, r.refers_to) for r in rs) for i, rs in by.items()}
    assert kinds[1] == kinds[2] == [("revisit", 9)] and kinds[9] == [("response", None)]
    assert kinds[3] == kinds[4] == kinds[5] == kinds[6] == [("response", None)]
    assert kinds[None] == [("revisit", 7)] and kinds[8] == [("response", None), ("revisit", 8)]
    assert len(list(warc.members(open(f"{tmp_path}/w/{got[0].file}", "rb").read()))) >= 1


def test_same_rows_give_the_same_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"http://x/{i}", f"{i} " * (i % 500)) for i in range(3000)], "page_id long, url string, html string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    names = []
    for out, n in (("a", 2), ("b", 7)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        warc.write(spark.read.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/{out}", shard_bytes=300_000, roll_bytes=40_000)
        names.append({f: hashlib.sha256(open(f"{tmp_path}/{out}/{f}", "rb").read()).hexdigest() for f in os.listdir(f"{tmp_path}/{out}") if f.endswith(".gz")})
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert names[0] == names[1] and len(names[0]) > 4
    assert not [f for f in os.listdir(f"{tmp_path}/a") if f.endswith(".tmp")]


def test_damage_is_seen_and_empty_tables_work(spark, tmp_path):
    member = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None, False, 0)
    with pytest.raises(ValueError):
        list(warc.members(member[:-9]))
    folder = f"file://{tmp_path}/e"
    assert warc.write(pages(spark).limit(0), folder).collect() == [] and warc.read(spark, folder).collect() == []


TEXTS = [(1, "Hello world, this is text."), (2, None), (3, ""), (4, "é" * 5000), (5, "<|endoftext|> as plain text"), (5, "<|endoftext|> as plain text"), (None, "x"), (6, "word " * 40000)]


def test_counts_equal_tokenising_again(spark, tmp_path):
    docs = spark.createDataFrame([(*t, "f", 0) for t in TEXTS], "doc_id long, text string, file string, nth int").repartition(2)
    folder = f"file://{tmp_path}/t"
    order = tc.write(docs, folder, roll_bytes=20_000)
    got = order.join(tc.count(spark, folder, tc.listed(spark, folder), block_tokens=7), ["file", "nth"]).collect()
    encode = tc.encoder(open(tc.VOCABULARY, "rb").read())
    want = sorted((str(d), len(encode(t)) if t else 0) for d, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in tc.counted(docs).collect()) == want
    assert tc.counted(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [1, 3, 5, 1000])
def test_scan_stitches_documents_across_blocks(spark, tmp_path, block):
    end, files = 9, {"a.bin": [1, 2, 9, 9, 3, 4, 5, 6, 7, 8, 9, 1], "b.bin": [9], "c.bin": [1, 2], "d.bin": []}
    rows = []
    for name, ids in files.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
        rows.append((name, len(ids)))
    got = tc.count(spark, f"file://{tmp_path}", spark.createDataFrame(rows, "file string, n_tokens long"), end, block).collect()
    assert sorted((r.file, r.nth, r.start, r.n_tokens) for r in got) == [("a.bin", 0, 0, 2), ("a.bin", 1, 3, 0), ("a.bin", 2, 4, 6), ("a.bin", 3, 11, 1), ("b.bin", 0, 0, 0), ("c.bin", 0, 0, 2)]
