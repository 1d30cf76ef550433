"""Hard negatives against brute force, with odd vectors, and what the index saves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.llm import hard_negatives as H

RNG = random.Random(9)


def brute(rows, every, low=30, high=90):
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for i, (label, v) in anchors.items():
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, other) for j, other, u in ok if j != i)
        for k, (p, j, _) in enumerate([s for s in scored if s[2] == label][:5]):
            fit = [s for s in scored if s[2] != label and low * -p <= 100 * -s[0] <= high * -p][:10]
            out += [(i, k + 1, j, -p, r + 1, s[1], -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every, **options):
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, window int, T int")
    got = H.hard_negatives(x, F.col("vec_id") % every == 0, **options)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_rank", "positive_id", "positive_score", "rank", "negative_id", "negative_score"))
                  for r in got.collect())


def vector(size=12, scale=1.0):
    return [RNG.uniform(-scale, scale) for _ in range(size)]


@pytest.fixture(scope="module")
def rows():
    some = [(i, vector(), RNG.randrange(4), 1, 2) for i in range(300)]
    some += [(300 + i, some[5][1], RNG.randrange(4), 1, 2) for i in range(60)]  # one common vector
    some += [(i, vector(), 9, 1, 2) for i in range(400, 403)]  # a rare label: fewer than five positives
    some += [(500, [0.0] * 12, 1, 1, 2), (520, [], 2, 1, 2), (540, vector(5), 0, 1, 2), (560, vector(12, 1000.0), 3, 1, 2),
             (580, None, 1, 1, 2), (600, [1.0, None], 1, 1, 2), (620, [float("nan")], 1, 1, 2), (640, [float("inf")], 1, 1, 2),
             (660, vector(), None, 1, 2), (None, vector(), 1, 1, 2), (680, [5e8] * 12, 2, 1, 2), (20, some[20][1], some[20][2], 1, 2),
             (7, some[7][1], some[7][2], 1, 2), (40, vector(), 0, 1, 2)]
    return some


@pytest.mark.parametrize("tile", [2048, 37])
def test_is_brute_force(spark, rows, tile, monkeypatch):
    monkeypatch.setattr(H, "ROWS_TILE", tile)
    monkeypatch.setattr(H, "ANCHORS_TILE", 11 if tile < 100 else 1024)
    want = brute(rows, 20)
    assert mined(spark, rows, 20) == want and len(want) > 300
    assert mined(spark, rows, 20, low=70, high=120) == brute(rows, 20, 70, 120)


def test_small_and_empty_tables(spark):
    assert mined(spark, [], 1) == []
    one = [(1, [1.0], 1, 1, 2)]
    assert mined(spark, one, 1) == []
    zero = [(1, [0.0], 1, 1, 2), (2, [1.0], 1, 1, 2), (3, [2.0], 2, 1, 2), (4, [0.0], 2, 1, 2)]
    assert mined(spark, zero, 1) == brute(zero, 1)  # a window of the score 0 alone


def test_the_index_leaves_out_and_drops():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(2000, 64)) * np.geomspace(1, 0.01, 64))
    q = x[:40]
    exact = q @ x.T
    for part in (0.9, 0.5, -100.0):
        floors = part * np.sqrt((q**2).sum(1) * np.median((x**2).sum(1)))
        index = H.Index(x, q, floors)
        for i, floor in enumerate(np.floor(floors).astype(int).tolist()):
            at, score = index.reaching(i, floor)
            want = np.flatnonzero(exact[i] >= floor)
            assert np.sort(at).tolist() == want.tolist()
            assert (score == exact[i][at]).all()
        whole = len(x) * len(q) * len(index.cuts)
        listed = sum(index.sizes) / (len(x) * len(index.cuts))
        assert (listed < 0.6 and index.touched < 0.4 * whole) if part > 0 else (listed == 1 and index.touched == whole)
