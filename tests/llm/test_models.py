"""Language, quality, toxicity and PII models: held-out accuracy, exactness of their inference, edge cases."""

import itertools
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import langid, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
EDGE = [(0, None, "x", 1.0), (1, "", "x", 1.0), (2, " \n\t", "x", 1.0), (3, "123 456 !!!", "x", 1.0), (4, "the and of with " * 20000, "x", 1.0), (4, "the and of with " * 20000, "x", 1.0), (None, "und der die das\n" * 3, "x", 1.0), (6, "x" * 300_000, "x", 1.0)]
SCHEMA = "doc_id long, text string, lang_pred string, score double"
have_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def auc(y, s):
    y, s = np.asarray(y), np.asarray(s)
    rank = np.empty(len(s))
    order = np.argsort(s, kind="stable")
    rank[order] = np.arange(1, len(s) + 1)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("n,seed", [(1, 0), (7, 1), (200, 2)])
def test_forward_backward_equals_enumeration(n, seed):
    r = np.random.default_rng(seed)
    k = 2 if n > 7 else 3
    e, t, s = r.normal(size=(n, k)), r.normal(size=(k, k)), r.normal(size=k)
    first = r.random(n) < 0.3
    first[0] = True
    post, moved = langid.forward_backward(e, first, t, s, pairs=True)
    want, pairs = np.zeros((n, k)), np.zeros((k, k))
    cuts = [*np.flatnonzero(first), n]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 9:
            continue
        paths = list(itertools.product(range(k), repeat=b - a))
        w = np.array([np.exp(s[p[0]] + sum(e[a + i, y] for i, y in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        w /= w.sum()
        for p, x in zip(paths, w):
            for i, y in enumerate(p):
                want[a + i, y] += x
            for x0, y0 in zip(p, p[1:]):
                pairs[x0, y0] += x
        assert np.allclose(post[a:b], want[a:b])
    if max(np.diff(cuts)) <= 9:
        assert np.allclose(moved, pairs)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_viterbi_equals_enumeration(seed):
    r = np.random.default_rng(seed)
    n, k = 30, 3
    e, t, s = r.normal(size=(n, k)), r.normal(size=(k, k)), r.normal(size=k)
    first = r.random(n) < 0.3
    first[0] = True
    y = pii.viterbi(e, first, t, s)
    cuts = [*np.flatnonzero(first), n]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 8:
            continue
        best = max(itertools.product(range(k), repeat=b - a), key=lambda p: s[p[0]] + sum(e[a + i, v] for i, v in enumerate(p)) + sum(t[x, v] for x, v in zip(p, p[1:])))
        assert tuple(y[a:b]) == best


@have_tables
def test_language_of_held_out_documents(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == 1000
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases_and_code_switching(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and of with from this that is was", "en"), ("der die das und nicht ist von mit auf", "de")] * 20)]
    model = langid.train([t for _, t, _ in rows], [lang for *_, lang in rows])
    docs = spark.createDataFrame(EDGE, SCHEMA)
    got = langid.predicted(docs, model).collect()
    assert len(got) == len(EDGE)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert [by[i][0] for i in (0, 1, 2, 3)] == ["und"] * 4 and by[4][0] == "en" and by[None][0] == "de"
    assert [x[2] for x in model.runs("the and of this that is und nicht das der die von")] == ["en", "de"]
    assert langid.predicted(docs.limit(0), model).collect() == []
    assert langid.train([], []).predict(["a"]) == (["und"], [0.0])
    known = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert langid.fit(known).labels == []


@have_tables
def test_quality_of_held_out_documents(spark):
    got = queries.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert auc([r.quality for r in held], [r.score for r in held]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_quality_finds_a_bad_passage_in_a_long_text():
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    good = ["\n".join(line(40) for _ in range(r.integers(1, 12))) for _ in range(200)]
    bad = ["\n".join([line(40) for _ in range(r.integers(0, 6))] + [" ".join(w + "###" for w in line(40).split())] + [line(40) for _ in range(r.integers(0, 6))]) for _ in range(200)]
    m = quality.train(good[:150] + bad[:150], [1] * 150 + [0] * 150, 0.5)
    s = quality.by_block(good[150:] + bad[150:], m.score_texts)
    assert auc([1] * 50 + [0] * 50, s) > 0.97
    x, doc = quality.passages([bad[0], "", "a"])
    assert set(doc) == {0, 1, 2} and np.isfinite(x).all() and (np.diff(doc) >= 0).all()


def test_scores_of_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    q = quality.train(["good text here.", "### $$$ %%%"] * 10, [1, 0] * 10, 0.5)
    t = toxicity.train(list(range(20)), ["you idiot", "fine day"] * 10, [1, 0] * 10, 0.5)
    for df in (quality.scored(docs, q), toxicity.scored(docs, t)):
        got = df.collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(docs.limit(0), q).collect() == [] and toxicity.scored(docs.limit(0), t).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none).score_texts(["a"])[0] == 0.5 and toxicity.fit(docs, none).score(["a"])[0][0] == 0.5
    kept = quality.accepted(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(EDGE)


@pytest.mark.parametrize("sparse", [3, 12, 10_000])
def test_nearest_examples_equal_brute_force(monkeypatch, sparse):
    monkeypatch.setattr(toxicity, "SPARSE", sparse)
    r = np.random.default_rng(3)
    n, m = 700, 40
    x = r.random((n, m)) * (r.random((n, m)) < 0.15)
    x[300:320] = x[299]  # ties
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    doc, term = np.nonzero(x)
    index = toxicity.Index(doc, term, x[doc, term], n, m)
    for i in range(40):
        q = r.random(m) * (r.random(m) < 0.2) if i else x[299].copy()
        terms = np.flatnonzero(q)
        ids, sims = index.nearest(terms, q[terms], 15)
        s = x @ q
        want = [i for i in np.lexsort((np.arange(n), -s.round(12))) if s[i] > 0][:15]
        assert list(ids) == want and np.allclose(sims, s[want])


@have_tables
def test_toxicity_scores_equal_brute_force(spark):
    """The whole score on 300 texts: terms, TF-IDF with relevance, all cosines, votes and calibration, in plain loops."""
    import math

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(600).collect()]
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    learn = [(d, t, label[d]) for d, t in docs if label.get(d) is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    learn += learn[:3]  # copies
    model = toxicity.train([d for d, *_ in learn], [t for _, t, _ in learn], [y for *_, y in learn], 0.2)

    def terms(text):
        out = {}
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for x in {w, ("begin", w[:4]) if len(w) > 4 else w}:
                out[x] = out.get(x, 0) + 1
        return out

    unique = {t: y for _, t, y in learn}
    n, n1 = len(unique), sum(unique.values())
    df, df1 = {}, {}
    for t, y in unique.items():
        for x in terms(t):
            df[x] = df.get(x, 0) + 1
            df1[x] = df1.get(x, 0) + y

    def factor(x):
        if x not in df:
            return math.log((1 + n) / 2) + 1
        cells = [(df1[x], df[x] * n1 / n), (df[x] - df1[x], df[x] * (n - n1) / n), (n1 - df1[x], (n - df[x]) * n1 / n), (n - n1 - df[x] + df1[x], (n - df[x]) * (n - n1) / n)]
        g = 2 * sum(o * math.log(o / e) for o, e in cells if o > 0)
        evidence = math.sqrt(max(g, 0)) if df1[x] * n > df[x] * n1 else 0
        return (math.log((1 + n) / (1 + df[x])) + 1) * (1 + max(evidence - toxicity.EVIDENCE, 0) ** toxicity.POWER)

    def vector(text):
        v = {x: (1 + math.log(c)) * factor(x) for x, c in terms(text).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()}

    examples = [(d, vector(t), y) for d, t, y in learn]
    share = sum(y for *_, y in learn) / len(learn)
    test = [t for _, t in docs[:300]]
    got, evidence = model.score(test)
    for text, score, near in zip(test, got, evidence):
        v = vector(text) if terms(text) else {}
        cosines = sorted((sum(w * e.get(x, 0) for x, w in v.items()) for _, e, _ in examples), reverse=True)
        want = [c for c in cosines if c > 0][: toxicity.K]
        assert np.allclose([c for _, c, _ in near], want, atol=1e-9)
        cost = {1: 0.2 / share, 0: 0.8 / (1 - share)}
        up, down = sum(c * cost[y] * y for _, c, y in near) + toxicity.PRIOR_WEIGHT * 0.2, sum(c * cost[y] for _, c, y in near) + toxicity.PRIOR_WEIGHT
        p = min(max(up / down if near else 0.2, 1e-4), 1 - 1e-4)
        assert abs(score - 1 / (1 + math.exp(-(model.slope * math.log(p / (1 - p)) + model.shift)))) < 1e-9
    assert len(set(got.round(9).tolist())) > 200 and sum(not e for e, t in zip(evidence, test) if terms(t)) == 0


def test_toxic_words_and_word_beginnings_in_texts_of_any_length():
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), r.integers(2, 8)))
    clean = lambda n: [word() for _ in range(n)]
    make = lambda bad, n: " ".join(r.permutation(clean(n) + ([f"vexq{word()}" for _ in range(3)] if bad else [])))
    y = [i % 2 for i in range(400)]
    texts = [make(v, int(r.integers(5, 200))) for v in y]
    m = toxicity.train(list(range(400)), texts, y, 0.5)
    test = [i % 2 for i in range(100)]
    s, evidence = m.score([make(v, int(r.integers(5, 3000))) for v in test])
    assert auc(test, s) > 0.99 and all(bool(e) for e, v in zip(evidence, test) if v)


def test_base_spans_equal_the_plain_patterns(spark):
    import random

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(2)

    def keep(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and pii.luhn(d)
        return 9 <= len(d) <= 15 if kind == "phone" else True

    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    for i in range(8000):
        t = "".join(r.choice("a1.@-+ (9%") if i % 2 else r.choice("0123456789 -.+") for _ in range(50))
        want = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, t) if keep(k, m.group())]
        assert pii.base_spans(t) == want, t


def test_pii_model_and_edge_cases(spark):
    model = pii.default_model()
    table = pii.labelled_table(300, 99)
    words = pii.Words(["\n".join(" ".join(w for w, _ in s) for s in table)])
    y = np.array([pii.LABELS.index(label) for s in table for _, label in s])
    assert (model.labels(words) == y).mean() > 0.97
    docs = spark.createDataFrame([*EDGE, (7, "call +1 (988) 555-2485 or a.b@c.de, password=b7db7aa4a5fcc78305 now", "x", 1.0)], SCHEMA)
    got = {r.doc_id: r.pii for r in pii.found(docs, model).collect()}
    assert (got[7].n_phone, got[7].n_email, got[7].n_card, got[7].n_ip) == (1, 1, 0, 0)
    assert got[7].spans == "email:26:34,phone:5:22,secret:36:63"
    assert all(got[i].spans == "" for i in (0, 1, 2, 4, None, 6))
    assert pii.found(docs.limit(0), model).collect() == []


def test_pii_neighbours_stay_apart_and_spaced_addresses_are_found():
    model = pii.default_model()
    added = lambda t: model.added([t], [pii.base_spans(t)])[0]
    assert added("call 555-123-4567 555-987-6543") == [("phone", 5, 17), ("phone", 18, 30)]
    one, two = "api_key=0a1b2c3d4e5f60718293a4b5c6d7e8f9", "token=9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    assert added(f"{one} {two} ok") == [("secret", 0, 40), ("secret", 41, 79)]
    # a base span cuts its words out of a run, the rest of the run stays
    t = f"{one} 10.1.2.3 {two}###"
    assert pii.base_spans(t) == [("ip", 41, 49)] and added(t) == [("secret", 0, 40), ("secret", 50, 88)]
    r = np.random.default_rng(7)
    part = lambda a, b: "".join(r.choice(list("abcdefghiklmnoprstu"), r.integers(a, b)))
    found = 0
    for _ in range(200):
        name, host = part(3, 9), part(3, 8) + ".com"
        t = f"please write to {name} (at) {host} today"
        found += ("email", 16, 16 + len(f"{name} (at) {host}")) in added(t)
    assert found > 190
    assert not pii.evident("card", "4111111111111112") and pii.evident("card", "4111 1111 1111 1111") and not pii.evident("phone", "12-34")


def test_pii_query_equals_a_plain_version(spark):
    """found against plain patterns, a plain Viterbi and spans joined word by word."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def keep(kind, m):
        d = re.sub("[^0-9]", "", m)
        ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0, "phone": 9 <= len(d) <= 15}
        return ok[kind]

    model = pii.default_model()

    def plain_labels(e, first):
        y, s, back = [], None, []
        rows = [*range(len(e)), None]
        for i in rows:
            if i is None or (first[i] and s is not None):
                if s is not None:
                    now, path = int(s.argmax()), []
                    for bp in reversed(back):
                        path.append(now)
                        now = bp[now]
                    y += [*reversed([*path, now])] if not path else [*reversed([*path, now])]
                if i is None:
                    break
                s, back = None, []
            if s is None:
                s = model.start + e[i]
            else:
                t = s[:, None] + model.trans
                back.append(t.argmax(0))
                s = t.max(0) + e[i]
        return y

    def plain_spans(text):
        base = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if keep(k, m.group())]
        w = pii.Words([text])
        y = plain_labels(model.emission(w.features), w.first)
        added, cur = [], None
        for i, v in enumerate(y):
            s, e = int(w.start[i]), int(w.end[i])
            label = pii.LABELS[v]
            touches = any(s < b and a < e for _, a, b in base)
            if label == "O" or touches:
                cur = None
                continue
            begin, kind = label.split("-")
            if cur is None or begin == "B" or cur[0] != kind or w.first[i]:
                cur = [kind, s, e]
                added.append(cur)
            else:
                cur[2] = e
        added = [(k, *pii.trimmed(text, s, e)) for k, s, e in added]
        return base, [x for x in added if pii.evident(x[0], text[x[1] : x[2]])]

    table = pii.labelled_table(260, 5151)
    texts = ["\n".join(" ".join(w for w, _ in s) for s in table[i : i + 4]) for i in range(0, 260, 4)]
    texts += [" ".join(w for w, _ in table[0]) * 40, None, ""]
    got = pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    import hashlib

    n = 0
    for r in got:
        base, added = plain_spans(r.text or "")
        n += len(added)
        show = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(x, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2])))
        assert r.pii.spans == show(base + added), r.text
        assert (r.pii.n_secret, r.pii.n_found) == (sum(k == "secret" for k, *_ in added), len(base + added))
        assert r.pii.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest()
        every = sorted((a, b) for _, a, b in base + added)
        assert not [1 for (_, b), (a, _) in itertools.pairwise(sorted((a, b) for _, a, b in added)) if a < b]
        assert all(not (a < b1 and a1 < b) for _, a, b in added for _, a1, b1 in base) and every == sorted(every)
    assert n > 50
