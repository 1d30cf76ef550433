"""Exact top-k inner-product search with three phases and one uniform threshold.

A score is the sum of the partial scores of `slices` groups of dimensions. Rows and queries lie in
tiles; in a tile every slice is a list of partial scores.

1. Each list sends its k best entries; only these are resolved. The k-th best of a query's entries is
   a safe cutoff, as at least k rows reach it.
2. The cutoff goes back to the tiles. The slices are gone through once more, and an entry stays while
   what it has so far and the most that the other slices can add (the product of the norms of what is
   left of both vectors) reach the cutoff. Later slices are added up for the entries left alone.
3. Entries that were left after the last slice are resolved exactly, and the k best of a tile passed on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm.tables import written

K, SLICES, SCALE = 5, 4, 256
ROWS_TILE, QUERIES_TILE = 1024, 2048
#: Share of a tile's entries from which a slice is added up as one product.
DENSE = 0.1


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while these are exact, else in 64-bit integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _resolved(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return _scores(query[None, :], rows)[0]


def _rests(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Norm of the whole vector and of what follows each slice, rounded up."""
    energy = np.stack([(x[:, c].astype(float) ** 2).sum(1) for c in cuts])
    after = np.concatenate([np.cumsum(energy[::-1], 0)[::-1], np.zeros((1, len(x)))])
    return np.sqrt(after) * (1 + 1e-9)


def listed(q: np.ndarray, r: np.ndarray, own: np.ndarray, k: int, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """The rows that are among the k best of some slice's list, for every query; own: queries x rows to leave out."""
    pick = np.zeros((len(q), len(r)), bool)
    for c in cuts:
        part = _scores(q[:, c], r[:, c]).astype(float)
        part[own] = -np.inf
        if k < len(r):
            np.put_along_axis(pick, np.argpartition(part, len(r) - k, axis=1)[:, len(r) - k :], True, axis=1)
        else:
            pick[:] = True
    return [np.flatnonzero(x) for x in pick & ~own]


def reaching(q: np.ndarray, r: np.ndarray, own: np.ndarray, cutoff: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """The rows whose bound reaches the query's cutoff after every slice; a later slice is added up for these alone."""
    left_q, left_r = _rests(q, cuts), _rests(r, cuts)
    slack = np.outer(left_q[0], left_r[0]) * 1e-9  # rounding
    alive, seen = ~own, np.zeros(own.shape)
    for j, c in enumerate(cuts):
        if alive.mean() > DENSE:  # one product is cheaper than picking out most of the rows; the entries left are the same
            seen += _scores(q[:, c], r[:, c])
        else:
            for i in np.flatnonzero(alive.any(1)):
                at = np.flatnonzero(alive[i])
                seen[i, at] += _resolved(q[i, c], r[np.ix_(at, c)])
        alive &= ~(seen + np.outer(left_q[j + 1], left_r[j + 1]) + slack < cutoff[:, None])
    return [np.flatnonzero(x) for x in alive]


def _tile(k: int, slices: int):
    def run(key, queries, rows):
        if not queries.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        lengths = [c.combine_chunks().value_lengths().to_numpy().max(initial=0) for c in (queries.column("qv"), rows.column("v"))]
        width = max(1, int(max(lengths)))
        qid, rid = queries.column("qid").to_numpy(), rows.column("vec_id").to_numpy()
        order = np.argsort(rid, kind="stable")  # ties go to the smaller id
        rid = rid[order]
        q, r = _matrix(queries.column("qv"), width), _matrix(rows.column("v"), width)[order]
        cuts = np.array_split(np.arange(width), min(slices, width))
        own = qid[:, None] == rid[None, :]
        if "cutoff" in queries.column_names:
            found = reaching(q, r, own, queries.column("cutoff").to_pandas().to_numpy(dtype=float, na_value=-np.inf), cuts)
        else:
            found = listed(q, r, own, k, cuts)
        out: list[tuple] = []
        for i, at in enumerate(found):
            score = _resolved(q[i], r[at])
            best = np.argsort(-score, kind="stable")[:k]
            out.append((np.full(len(best), qid[i]), rid[at[best]], score[best]))
        return pa.table({n: pa.array(np.concatenate([o[j] for o in out])) for j, n in enumerate(("query_id", "vec_id", "score"))})
    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = K,
            slices: int = SLICES, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose id is divisible by `every`.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components,
    and null ids, take no part. Rows with the query's own id are its own; other repeated rows count
    as often as they come. A query id that occurs more than once is asked once, with the least of its
    vectors. Shorter vectors are filled with zeros. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf), F.lit(False))))
    x = x.select("vec_id", F.transform("v", lambda e: F.floor(e * scale).cast("double")).alias("v"))
    x = written(x, "vectors")
    asked = x.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("qid")).agg(F.min("v").alias("qv"))
    n, m = x.count(), asked.count()
    rows_in, asked_in = max(1, math.ceil(n / ROWS_TILE)), max(1, math.ceil(m / QUERIES_TILE))
    spread = F.explode(F.sequence(F.lit(0), F.lit(asked_in - 1)))
    rows = x.withColumn("t", F.pmod(F.xxhash64("vec_id", "v"), F.lit(rows_in)).cast("int"))
    rows = rows.withColumn("t", F.pmod(F.monotonically_increasing_id() + F.col("t"), F.lit(rows_in)).cast("int"))
    rows = rows.withColumn("s", spread)
    asked = asked.withColumn("s", F.pmod(F.xxhash64("qid"), F.lit(asked_in)).cast("int"))
    tiles = asked.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(rows_in - 1))))
    shape = "query_id long, vec_id long, score long"

    def search(queries: DataFrame) -> DataFrame:
        return queries.groupBy("s", "t").cogroup(rows.groupBy("s", "t")).applyInArrow(_tile(k, slices), shape)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    entries = search(tiles).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoff = written(entries.where(F.col("rank") == k).select(F.col("query_id").alias("qid"), F.col("score").cast("double").alias("cutoff")),
                     "cutoffs")
    # fewer than k rows in all: no cutoff
    second = search(tiles.join(cutoff, "qid", "left"))
    return second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
