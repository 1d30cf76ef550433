"""op10 averages the predictions of whole seatings: every chain has its own tables of pairs and words."""
import math
import zlib

import numpy as np

TEXTS = [(i, f"a b c{i % 3} a b a") for i in range(40)] + [(50, ""), (51, "b a b new"), (52, None), (None, "a b unmet")]


def test_score_is_the_mean_of_the_chains_predictions(spark):
    from lendframe.llm import language_model as L
    from lendframe.llm import words as W
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    train = [t or "" for i, t in TEXTS if i is not None and zlib.crc32(str(i).encode()) % 10]
    words, once, again, totals = L.seatings(spark.createDataFrame([(t,) for t in train], "text string"), 5, L.CHAINS)
    word, pair = {r.hash: r for r in words.collect()}, {(r.u, r.w): (r.n, [1] * L.CHAINS) for r in once.collect()}
    seats = again.collect()
    pair |= {(r.u, r.w): (r.n, [r[f"t{i}"] for i in range(L.CHAINS)]) for r in seats}
    for i in range(L.CHAINS):  # the tables of the pairs are the customers of the words, in every chain
        for h, r in word.items():
            assert r[f"c{i}"] == sum(t[i] for (_, w), (_, t) in pair.items() if w == h)
            assert r[f"x{i}"] == sum(t[i] for (u, _), (_, t) in pair.items() if u == h) and 1 <= r[f"t{i}"] <= r[f"c{i}"]
    assert len({tuple(r[f"t{i}"] for r in seats) for i in range(L.CHAINS)}) > 1

    def key(x):
        data = np.frombuffer(x.encode(), np.uint8)
        return int(L._tokens(W.find(data, np.array([0, len(data)]), W.spaced()))[0][0].view(np.int64)) if x else 0

    def chance(before, token, i):
        r, c = word.get(token), word.get(before)
        parent = L._parent(r[f"c{i}"], r[f"t{i}"], totals[i]) if r else L._parent(0, 0, totals[i])
        n, t = pair.get((before, token), (0, [0] * L.CHAINS))
        rest = L.STRENGTH + L.DISCOUNT * (c[f"x{i}"] if c else 0)
        return (max(n - L.DISCOUNT * t[i], 0) + rest * parent) / (L.STRENGTH + (c.n if c else 0))

    texts = dict(TEXTS)
    for r in L.scored(docs).collect():
        tokens = [key(x) for x in (texts[r.doc_id] or "").split()] + [0]
        want = sum(math.log10(sum(chance(b, t, i) for i in range(L.CHAINS)) / L.CHAINS) for b, t in zip([0, *tokens], tokens))
        assert abs(want - r.score) < 1e-9 * (1 + abs(want))


def test_repeated_rows_are_scored_alike(spark):
    from lendframe.llm.language_model import scored
    docs = spark.createDataFrame(TEXTS * 3, "doc_id long, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    got = {}
    for r in scored(docs).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert all(len(x) == 3 and len(set(x)) == 1 for x in got.values()) and len(got) == len(TEXTS)


def test_packed_numbers_come_back():
    from lendframe.llm.language_model import _packed, _unpacked
    for x in ([], [0, 255], [1, 256], [70_000], [1 << 40, 3]):
        assert _unpacked(_packed(np.array(x, np.int64))).tolist() == x
