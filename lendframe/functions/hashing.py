"""Seeded draws from row keys: the same key and seed give the same draw on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX32 = float(16 ** 8)


def seeded_hash(key: Column, seed) -> Column:
    """md5 text of ``key:seed``; sorting by it shuffles the rows."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", key.cast("string"), seed.cast("string")).cast("binary"))


def hex_int(text: Column, start: int = 1, digits: int = 8) -> Column:
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def hash_uniform(key: Column, seed) -> Column:
    """Uniform draw in [0, 1)."""
    return hex_int(seeded_hash(key, seed)) / F.lit(HEX32)


# Cumulative Poisson(1) probabilities for 0..7 events
POISSON1 = [0.36787944, 0.73575888, 0.91969860, 0.98101184,
            0.99634015, 0.99940582, 0.99991676, 0.99998975]


def poisson1(hex8: Column) -> Column:
    """Poisson(1) count from 8 hex digits read as a uniform draw.

    The digits are compared as text with the cumulative probabilities in hex, which gives the same
    order as the numbers and needs no conversion per row.
    """
    steps = [f"{math.ceil(c * HEX32):08x}" for c in POISSON1]
    out = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        out = F.when(hex8 < steps[k], F.lit(k)).otherwise(out)
    return out
