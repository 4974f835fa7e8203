import numpy as np
import pytest

from lattica.llm import simhash


def brute(values):
    p = list(range(len(values)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    u = np.array(values, np.int64).view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 2):
            a, b = find(i), find(i + 1 + int(j))
            p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(u))]


def near_values(seed, n):
    """Random fingerprints, and walks of one to four flipped bits from some of them."""
    r = np.random.default_rng(seed)
    out = list(r.integers(-(2**63), 2**63 - 1, n))
    for _ in range(n):
        x = int(out[int(r.integers(0, len(out)))])
        for b in r.choice(64, int(r.integers(1, 5)), replace=False):
            x ^= 1 << int(b) if b < 63 else -(1 << 63)
        out.append(x)
    return [0, 1, -1, *dict.fromkeys(int(v) for v in out)]


@pytest.mark.parametrize("lead", [1, 5, 21])
def test_links_equal_all_pairs(lead):
    r = np.random.default_rng(lead)
    base = np.uint64(0xABCDEF0123456789)
    x = np.unique(np.array([int(base) ^ sum(1 << int(b) for b in r.choice(64 - lead, int(r.integers(0, 4)), replace=False)) for _ in range(400)], np.uint64))
    x = x[np.argsort(simhash.gray_rank(x))]
    a, b = simhash.links(x, lead)
    got = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(np.bitwise_count(x[i] ^ x[j])) <= 2}
    assert got == want and len(got) == len(a)


@pytest.mark.parametrize("long_run", [20_000, 3])
def test_components_equal_brute_force(spark, long_run):
    values = list(dict.fromkeys(near_values(7, 300)))
    edges = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"), long_run)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute(values)
    groups = {}
    for v, w in zip(values, want):
        groups.setdefault(w, set()).add(v)
    linked = {}
    for v in values:
        linked.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, linked.values()))


def test_nulls_empty_repeats_extra_columns_and_one_stays(spark):
    rows = [(1, "a b c d e f g h", "x", 1), (2, "A  b c\td e f g h", "y", 2), (2, "A  b c\td e f g h", "y", 2), (3, None, None, 3), (4, "", "z", 4), (5, "q " * 30000, "z", 5), (None, "solo text here", "z", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.groups(docs).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (None, None)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 5]
    assert simhash.groups(docs.limit(0)).collect() == []
