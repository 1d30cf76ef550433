"""Registration: one name, one output shape, one Spark function and (mostly) one SQL text."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.plans.adapters import duck_view

# rounds a half up even when the two engines differ in the last bit of an exact half
HALF = 0.5007123
Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}
MODULES = ["features", "rows", "relations", "sampling", "metrics", "decisions", "fairness", "drift",
           "profiles", "encoding", "modelling", "explaining", "scenarios", "clustering", "storage"]


def _parts(spec: str) -> list[tuple[str, str]]:
    """"i:a,b d:c s:e" -> [("i", "a"), ("i", "b"), ("d", "c"), ("s", "e")]"""
    out = []
    for group in spec.split():
        kind, names = group.split(":", 1)
        out += [(kind, n) for n in names.split(",") if n]
    return out


def shape(df: DataFrame, spec: str) -> DataFrame:
    """i whole number, d number rounded to 4 (d2: 2) places, s text."""
    cols = []
    for kind, name in _parts(spec):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind.startswith("d"):
            scale = 10.0 ** int(kind[1:] or 4)
            c = F.floor(c.cast("double") * scale + HALF) / scale
        else:
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def shaped_sql(select: str, spec: str, views=(), ctes: str = "") -> str:
    cols = []
    for kind, name in _parts(spec):
        if kind == "i":
            cols.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind.startswith("d"):
            scale = f"1e{int(kind[1:] or 4)}"
            cols.append(f'floor(CAST("{name}" AS DOUBLE) * {scale} + {HALF}e0) / {scale} AS "{name}"')
        else:
            cols.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
    withs = [duck_view(v) for v in views] + ([ctes] if ctes else [])
    head = f"WITH {', '.join(withs)} " if withs else ""
    return f"{head}SELECT {', '.join(cols)} FROM ({select}) AS answer"


def add(name: str, spec: str, run: Run, select: str | None = None, views=(), ctes: str = "") -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: shape(run(spark, sf_dir), spec)
    if select:
        ORACLES[name] = shaped_sql(select, spec, views, ctes)


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"lendframe.queries.{module}")
