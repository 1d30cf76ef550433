"""The suffix order of line runs is refined until no group is left, and says how deep a repeat is."""
import random

import pytest


def _lines(spark, texts):
    rows = [(d, 0, k, ord(x)) for d, s in texts for k, x in enumerate(s)]
    return spark.createDataFrame(rows, "doc_id long, th long, seq int, line long")


def _want(texts, min_lines):
    """Place -> most lines, min_lines times a power of two, that start there and at an earlier place."""
    places = [(d, k, s[k:]) for d, s in sorted(texts) for k in range(len(s))]
    out, size = {}, min_lines
    while size <= max(len(s) for _, s in texts):
        seen = set()
        for d, k, rest in places:
            if len(rest) >= size:
                if rest[:size] in seen:
                    out[d, k] = size
                seen.add(rest[:size])
        size *= 2
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_runs_are_doubled_until_all_are_told_apart(spark, min_lines):
    from lendframe.llm.line_dedup import later_runs
    rng = random.Random(min_lines)
    texts = [(d, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for d in range(6)]
    texts += [(8, "pqrstuvwxyz"), (9, "opqrstuvwxyz"), (10, "~" * 9)]
    got = {(r.doc_id, r.seq): r.size for r in later_runs(_lines(spark, texts), min_lines).collect()}
    assert got == _want(texts, min_lines)
    assert got[9, 1] == {1: 8, 2: 8, 3: 6}[min_lines]


def test_nothing_repeated_has_no_runs(spark):
    from lendframe.llm.line_dedup import later_runs
    assert later_runs(_lines(spark, [(1, "abc"), (2, "def")]), 2).count() == 0
    assert later_runs(_lines(spark, [(1, "abx"), (2, "aby")]), 3).count() == 0
