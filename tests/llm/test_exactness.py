"""Operators against slow, independent versions; placement of shards; columns whose names clash with those of the operators."""

import math
import os
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import decontaminate, exact_dedup, langid, packing, pii, quality, simhash, stages, tokencount, toxicity, warc
from lattica.llm.common import cut, label_sample, located, without

SF = "/root/testdata/sf0.001"
have_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    hashes = [xxhash.xxh64(" ".join(s).encode("utf-8"), seed=42).intdigest() for s in shingles]
    out = 0
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            out |= 1 << bit
    return out


@have_tables
def test_fingerprints_equal_a_bit_by_bit_version(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += [None, "", " \t\r\n", "One", "ONE two", "a\x0bb\x0cc", "É é É É", "a\u00a0b c d e", "x " * 2001, "İstanbul Ünï " * 5]
    for t in texts:
        assert simhash.fingerprint(t) & ((1 << 64) - 1) == plain_fingerprint(t), t
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.fp & ((1 << 64) - 1) for r in simhash.groups(got).orderBy("doc_id").collect()] == [plain_fingerprint(t) for t in texts]


def test_attention_equals_plain_loops_and_its_gradients_finite_differences():
    r = np.random.default_rng(5)
    words = lambda n, mark: " ".join("".join(r.choice(list("abcdef"), 4)) + mark for _ in range(n))
    texts = ["\n".join(words(int(r.integers(1, 9)), m) for _ in range(int(r.integers(1, 5)))) for m in ("", "##") * 12] + [""]
    labels = [1, 0] * 12 + [1]
    model = quality.train(texts, labels, 0.4)
    x, doc = quality.passages(texts)
    got = model.score_texts(texts)
    p = {k: v.astype(float) for k, v in model.p.items()}
    x = (x - model.mean) / model.std

    def logit(i, p):
        rows = x[doc == i].astype(float)
        h = [np.tanh(v @ p["w"] + p["b"]) for v in rows]
        e = [sum(math.tanh(hh @ p["v"][:, j]) / (1 + math.exp(-(hh @ p["u"][:, j]))) * p["a"][j] for j in range(quality.GATE)) for hh in h]
        weight = [math.exp(v - max(e)) for v in e]
        weight = [w / sum(weight) for w in weight]
        return sum(w * hh for w, hh in zip(weight, h)) @ p["c"] + p["d"]

    for i in range(len(texts)):
        assert abs(got[i] - 1 / (1 + math.exp(-(logit(i, p) + model.shift)))) < 1e-5
    # one training step from small parameters against finite differences of the loss
    y = np.array(labels, float)
    cost = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def loss(p):
        z = np.array([logit(i, p) for i in range(len(texts))])
        return float((cost * (np.logaddexp(0, z) - y * z)).sum())

    model.p = {k: v.astype(np.float64) for k, v in p.items()}
    grad = quality.gradients(model, x.astype(np.float64), doc, len(texts), y, cost)
    for k in p:
        for at in list(np.ndindex(p[k].shape))[:: max(1, p[k].size // 6)]:
            up, down = ({n: np.array(v) for n, v in p.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs(grad[k][at] - (loss(up) - loss(down)) / 2e-5) < 1e-5, (k, at)


def test_language_equals_a_word_by_word_version(spark):
    """Emissions from features written out for each word, then forward and backward sums in plain loops."""
    rows = [("the and of with from this that", "en"), ("der die das und nicht ist von", "de"), ("les des une dans pour avec", "fr")] * 12
    model = langid.train([t for t, _ in rows], [lang for _, lang in rows])
    k = len(model.labels)
    r = np.random.default_rng(1)
    vocabulary = " ".join(t for t, _ in rows[:3]).split() + ["Straße", "ßx", "q", "été", "zzzz"]
    texts = [" ".join(r.choice(vocabulary, int(r.integers(1, 12)))) for _ in range(12)] + ["a1b!c", "12 34", "", None, "The\nUND"]

    def bucket(salt, *chars):
        h, mask = salt, (1 << 64) - 1
        for c, prime in zip(chars, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
            h = ((h ^ c) * prime) & mask
            h ^= h >> 31
        return h % langid.BUCKETS

    def emission(word):
        c = [1, *map(ord, word), 1]
        out = np.zeros(k)
        for n in (2, 3):
            for i in range(len(c) - n + 1):
                out += model.table[bucket(n, *c[i : i + n])] * 3.0 / len(c)
        for n in (2, 3, 4):
            if len(word) >= n:
                out += 0.5 * model.table[bucket(10 + n, *map(ord, word[:n]))]
                out += 0.5 * model.table[bucket(20 + n, *map(ord, word[::-1][:n]))]
        u = np.array(list(map(ord, word)), np.uint32)
        h = langid.span_hashes(u, np.array([0]), np.array([len(u)]))[0]
        at = np.flatnonzero(model.lexicon == h)
        return out + model.entries[at[0]] if len(at) else out

    def plain(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            return "und", 0.0
        e = [np.exp(emission(w)) for w in words]
        t, s = np.exp(model.trans), np.exp(model.start)
        f = [s * e[0]]
        for v in e[1:]:
            f.append((f[-1] @ t) * v)
        b = [np.ones(k)]
        for v in reversed(e[1:]):
            b.append(t @ (v * b[-1]))
        post = [x * y / (x @ y) for x, y in zip(f, reversed(b))]
        mass = sum(post)
        return model.labels[int(mass.argmax())], float(mass.max() / len(words))

    got = langid.predicted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r_ in got:
        lang, score = plain(r_.text)
        assert r_.lang_pred == lang and abs(r_.score - score) < 1e-4, r_.text


CLASH = "doc_id long, text string, source string, file string, at long, row string, __file string, __row long, __lang string, __toxic int, pii string, hit int, score double, fp string, component_id int, shard int, key string, tie int, digest string, `a.b` int"


def clashing(spark):
    rows = [(i, t, s, "same", 0, "r", "same", 0, "x", 1, "p", 1, 1.0, "f", 1, 0, "k", 1, "d", i) for i, (t, s) in enumerate([("alpha beta gamma delta", "s"), ("alpha beta gamma  delta", "s"), ("one two three", None), (None, "t"), ("", "t"), ("w3 w4 w5 and more words here", "u")])]
    return spark.createDataFrame(rows, CLASH)


def test_columns_with_clashing_names(spark):
    docs = clashing(spark)
    rows = docs.collect()
    given = lambda df: sorted(map(str, df.select([f"`{c}`" for c in docs.columns]).collect()))
    same = sorted(map(str, rows))
    lang = langid.train(["alpha beta", "one two"] * 4, ["a", "b"] * 4)
    out = langid.predicted(docs, lang)
    assert out.where("__lang = 'x' and file = 'same' and row = 'r'").count() == len(rows) and len(out.columns) == len(docs.columns) + 1
    tox = toxicity.scored(docs, toxicity.train([1, 2, 3, 4], ["alpha", "two", "alpha x", "two y"], [1, 0, 1, 0], 0.5))
    assert tox.where("__toxic = 1 and `a.b` = doc_id").count() == len(rows) and "evidence" in tox.columns
    assert pii.found(docs).where("row = 'r' and pii.spans = ''").count() == len(rows)
    bench = spark.createDataFrame([(1, "w3 w4 w5")], "item_id long, text string")
    for chars in (2_000_000, 1):
        found = decontaminate.find(docs, bench, chars=chars)
        assert {r.doc_id for r in found.collect() if r.hit["items"]} == {5} and found.where("file = 'same' and `a.b` = doc_id").count() == len(rows)
    assert given(decontaminate.clean(docs, bench)) == sorted(str(r) for r in rows if r.doc_id != 5)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.classes(docs).collect()} == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5)}
    assert given(exact_dedup.keep_first(docs)) == sorted(str(r) for r in rows if r.doc_id in (1, 2, 3, 5))
    assert {(r.doc_id, r.component_id) for r in simhash.groups(docs).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 5)}
    assert given(simhash.keep_one(docs)) == sorted(str(r) for r in rows if r.doc_id in (0, 2, 3, 5))
    assert packing.packed(docs).count() == len(rows) and tokencount.counted(docs).count() == len(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert given(quality.accepted(docs, none)) == same
    assert [n for n in stages.exact(spark, docs, "").columns] == docs.columns
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("source").alias("url"))
    assert warc.round_trip(pages).count() == len(rows)


def test_located_rows_are_apart_and_without_drops_the_named(spark):
    rows = located(clashing(spark))
    assert rows.select("file", "at").distinct().count() == 6
    left = without(rows, rows.where("row.doc_id < 4").select("file", "at"))
    assert sorted(r.doc_id for r in left.collect()) == [4, 5]


def test_sample_takes_all_labels_and_stays_bounded(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 100).cast("string").alias("label"))
    picked = label_sample(rows, "label", 20).groupBy("label").count().collect()
    assert len(picked) == 100 and 1500 < sum(r["count"] for r in picked) < 2500
    assert label_sample(rows.where("label = '3'"), "label", 1000).count() == 400
    assert label_sample(rows.limit(0), "label", 5).collect() == []
    text = "".join(chr(97 + i % 26) for i in range(10_000))
    t = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(cut(F.col("t"), 800).alias("t")).collect()
    pieces = t[0].t.split("\n")
    assert len(pieces) == 8 and all(len(x) == 100 and x in text for x in pieces) and pieces[0] == text[:100] and pieces[-1] == text[-100:]
    assert t[1].t == "short" and t[2].t is None


def test_language_learns_more_than_64_languages_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 1)
    rows = [(i * 10 + j, f"zz{i}q{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}uv " * (3 if i else 4000), f"l{i:02d}") for i in range(70) for j in range(6)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 70


def test_long_runs_of_any_class_are_tokenised(spark):
    encode = tokencount.encoder(open(tokencount.VOCABULARY, "rb").read())
    for s in (" " * 10_000_000, "\n" * 10_000_000, "x" * 10_000_000, "a" + " \t" * 600_000 + "b"):
        assert len(encode(s)) > 0
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokencount.VOCABULARY, "rb").read().splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for blank in (" ", "\n", "\t ", "\u00a0", "\u2003\n"):
        for left, right in (("", ""), ("a", ""), ("", "b"), ("a", "b"), (".", "'s"), ("1", " 2")):
            t = left + blank * 1500 + right + blank * 999 + right + blank * 1000
            assert encode(t) == plain(t), (blank, left, right)


def test_token_files_are_scanned_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * 50) for i in range(20)], "doc_id long, text string").repartition(2)
    plan = tokencount.counted(docs, f"file://{tmp_path}/t")._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "BroadcastHashJoin" not in plan.split("== Physical Plan ==")[1].split("SortMergeJoin")[0]


def test_shards_have_a_task_each(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 40 + 1), f"s{i % 9}") for i in range(4000)], "doc_id long, text string, source string")
    got = packing.packed(docs, capacity=64, shard_pieces=63).withColumn("task", F.spark_partition_id())
    tasks = {}
    for r in got.where("n_tokens > 0").select("task", "shard").distinct().collect():
        tasks.setdefault(r.task, []).append(r.shard)
    assert len(tasks) == 64 and all(len(s) == 1 for s in tasks.values())
    f = packing.fill(got, 64).first()
    assert f.n_tokens == sum(i % 40 + 1 for i in range(4000)) and 0 < f.fill <= 1


def test_one_very_long_text_is_dealt_to_many_shards(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").select("doc_id", F.when(F.col("doc_id") == 1, F.repeat(F.lit("w "), 10_000_000)).otherwise(F.col("text")).alias("text"), F.lit("s").alias("source"))
    got = packing.packed(docs)
    n = got.groupBy("shard").count().collect()
    assert sum(r["count"] for r in n) == math.ceil(10_000_000 / 2048) + 1
    got = packing.packed(docs, shard_pieces=100).groupBy("shard").count().collect()
    assert len(got) > 40 and max(r["count"] for r in got) < 200


def test_archives_do_not_depend_on_the_layout_of_the_input(spark, tmp_path):
    import hashlib

    rows = [(i // 2 if i % 7 else 5, f"http://x/{i % 11}", f"{i % 900} " * (i % 300)) for i in range(4000)] + [(5, None, "same " * 500)] * 40
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/one")
    spark.createDataFrame(rows[::-1], "page_id long, url string, html string").repartition(11).write.parquet(f"{tmp_path}/two")
    names = []
    for x in ("one", "two"):
        manifest = warc.write(spark.read.parquet(f"{tmp_path}/{x}"), f"file://{tmp_path}/w{x}", shard_bytes=100_000, roll_bytes=30_000)
        names.append({r.file: hashlib.sha256(open(f"{tmp_path}/w{x}/{r.file}", "rb").read()).hexdigest() for r in manifest.collect()})
    assert names[0] == names[1] and len(names[0]) > 8
    assert len({f.split("-")[1] for f in names[0]}) > 8
    got = warc.read(spark, f"file://{tmp_path}/wone").collect()
    assert len(got) == len(rows) and sum(r.record_type == "response" for r in got if r.payload_bytes >= 1000) == len({h for _, _, h in rows if len(h) >= 1000})
