import numpy as np
import pytest

from lattica.llm import packing


@pytest.mark.parametrize("seed,n_sources", [(1, 3), (2, 20), (3, 300)])
def test_takes_the_tightest_compatible_bin(seed, n_sources):
    r = np.random.default_rng(seed)
    n, cap = 700, 200
    sizes = sorted((r.integers(1, 120, n)).tolist(), reverse=True)
    raw = np.where(r.random(n) < 0.3, 0, r.integers(0, n_sources, n))
    order = {s: i for i, s in enumerate(sorted(set(raw.tolist()), key=lambda s: -(raw == s).sum()))}
    sources = [order[s] for s in raw.tolist()]
    clusters = np.where(r.random(n) < 0.2, r.integers(0, 20, n), -1).tolist()
    bins, offsets = packing.pack(sizes, sources, clusters, cap)
    state = {}  # bin -> what is left, sources, clusters
    for b, o, size, s, c in zip(bins, offsets, sizes, sources, clusters):
        fit = [x[0] for x in state.values() if x[0] >= size and s not in x[1] and (c < 0 or c not in x[2])]
        left, own_s, own_c = state.setdefault(b, (cap, set(), set()))
        assert left == min(fit) if fit else left == cap and not own_s
        assert o == cap - left and size <= left and s not in own_s and (c < 0 or c not in own_c)
        state[b] = (left - size, own_s | {s}, own_c | {c})


def test_whole_texts_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "a " * 5000, "s", 9), (2, None, None, 9), (3, "", "s", 9), (4, "x y z", None, 9), (5, " x y\tz ", "t", 9), (5, " x y\tz ", "t", 9), (None, "one", "u", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin int")
    got = packing.packed(docs, capacity=1000).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), *[(1, 1000)] * 5, (2, 0), (3, 0), (4, 3), (5, 3), (5, 3)]
    bins = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault((r.shard, r.bin), []).append(r.doc_id)
    assert all(sum(d in (4, 5) for d in b) <= 1 for b in bins.values())  # duplicates of each other
    assert all(sum(r.n_tokens for r in got if (r.shard, r.bin) == k) <= 1000 for k in bins)
    assert packing.packed(docs.limit(0)).collect() == []
