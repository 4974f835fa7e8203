import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import decontaminate as dc

LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(1, LONG), (2, "Short one!"), (3, None), (4, "..."), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (5, "Straße ÉCOLE")]


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items, size=10):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - size + 1) if v else 0):
            win = v[i : i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    ids.add(str(item))
                    hit.update(range(j, j + len(win)))
    return len(w), len(hit), sorted(ids)


TEXTS = [None, "", "   ", "a W3-w4 w5 w6 w7 w8 w9 w10 w11 w12 b", LONG.upper() + " " + LONG, "short\none short one", "xshort one", "straße École", "straße ÉCOLE", "w0 " * 40000 + "short one", " ".join(f"w{i}" for i in range(2, 14))]


@pytest.mark.parametrize("chars", [2_000_000, 60])
def test_equals_brute_force(spark, chars):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x")], "doc_id long, text string, hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.find(docs, bench, chars=chars).withColumn("n_hit", dc.n_hit()).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert (r.hit.n_words, r.n_hit, r.hit["items"]) == brute(r.text, ITEMS), r.doc_id
        for s in r.hit.spans:
            assert len(words(r.text[s.start : s.until])) > 0 and words(r.text[s.start : s.until])[0] == words(r.text)[r.hit.runs[r.hit.spans.index(s)].first]


def test_clean_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, hit string, n_words int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 6}
    assert dc.clean(docs.limit(0), bench).collect() == []
    assert dc.clean(docs, bench.limit(0)).count() == len(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "Ab", "é", "1"]), max_size=30), st.lists(st.lists(st.sampled_from(["a", "b", "AB", "é", "1"]), max_size=6), max_size=4))
def test_scan_equals_brute_force(text, items):
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    a = dc.automaton(dc.pattern_sets(items, 3)[0])
    n, runs, ids = dc.scan(" ".join(text), a)
    assert (n, sum(e - s for s, e in runs), ids) == brute(" ".join(text), items, 3)
