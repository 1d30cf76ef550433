"""Bin numbers. Bins include their left edge: [a, b)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Left edges and labels of the age bands
AGE_EDGES = [30.0, 45.0, 60.0]
AGE_LABELS = ["<30", "30-45", "45-60", "60+"]


def bin_index(value: Column, edges: Column) -> Column:
    """How many sorted edges are <= value."""
    return F.size(F.filter(edges, lambda e: e <= value))


def uniform_bin(value: Column, n_bins: int) -> Column:
    """Equal-width bin of a value in [0, 1]; 1.0 falls in the last bin."""
    edges = F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])
    return bin_index(value, edges)


def age_band(age: Column) -> Column:
    out = F.when(age >= 0, F.lit(AGE_LABELS[0]))
    for edge, label in zip(AGE_EDGES, AGE_LABELS[1:]):
        out = F.when(age >= edge, F.lit(label)).otherwise(out)
    return out
