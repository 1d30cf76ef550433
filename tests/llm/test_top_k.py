"""The threshold of the top-k search: what it leaves out, and that nothing else is left out."""

import numpy as np

from lendframe.llm import top_k as T


def _case(seed=4, rows=600, queries=40, width=32):
    rng = np.random.default_rng(seed)
    fall = 0.8 ** np.arange(width)
    r = np.floor(256 * rng.normal(size=(rows, width)) * fall)
    q = r[:queries].copy()
    own = np.arange(queries)[:, None] == np.arange(rows)[None, :]
    total = np.where(own, np.iinfo(np.int64).min, (q @ r.T).astype(np.int64))
    return q, r, own, total, np.array_split(np.arange(width), 4)


def test_lists_give_a_safe_cutoff_and_the_bound_leaves_few_entries():
    q, r, own, total, cuts = _case()
    lists = T.listed(q, r, own, 5, cuts)
    cutoff = np.array([np.sort(total[i, at])[-5] for i, at in enumerate(lists)], float)
    assert (cutoff <= np.sort(total, 1)[:, -5]).all()
    assert sum(map(len, lists)) <= 5 * len(cuts) * len(q)  # only these are resolved
    left = T.reaching(q, r, own, cutoff, cuts)
    for i, at in enumerate(left):
        assert set(np.flatnonzero(total[i] >= cutoff[i])) <= set(at)
    assert sum(map(len, left)) < 0.1 * own.size


def test_without_a_cutoff_all_other_rows_are_left():
    q, r, own, _, cuts = _case(rows=50, queries=5)
    left = T.reaching(q, r, own, np.full(5, -np.inf), cuts)
    assert [len(x) for x in left] == [49] * 5


def test_search_in_tiles_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_TILE", 64)
    monkeypatch.setattr(T, "QUERIES_TILE", 4)
    _, r, _, _, _ = _case()
    rows = [(i, (v / 256).tolist(), "x", 0) for i, v in enumerate(r)] + [(600, (r[0] / 256).tolist(), "x", 0)]
    got = T.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, qid string, cutoff int"), every=50).collect()
    whole = np.vstack([r, r[:1]]).astype(np.int64)
    for query in range(0, 601, 50):
        want = sorted((-int(whole[query] @ whole[i]), i) for i in range(601) if i != query)[:5]
        assert [(-x.score, x.vec_id) for x in sorted(got, key=lambda x: x.rank) if x.query_id == query] == want
