"""Exact k nearest neighbours of numeric vectors by even tiles.

Every tile of queries meets every tile of points once. In a tile a matrix product gives all squared
distances up to rounding; whatever may belong to the k nearest is measured again exactly, so results
don't depend on how rows are dealt out. The k best of the tiles are merged. No task holds more than
one tile of each side. A vote needs no list of neighbours: there a task holds its queries and all points come by.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS, QUERIES = 1 << 17, 1 << 15  # most rows of a tile; every row goes to all tiles of the other side
LEAST = 1024  # queries that are a tile in any case, and a quarter of the points
TASKS = 48
VOTERS = 1 << 14  # queries a task of a vote holds, each with its k nearest so far
CELLS = 1 << 22  # distances a matrix product holds


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def _best(k: int, same: bool):
    shape = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("d", pa.float64())])

    def run(queries, points):
        if not queries.num_rows or not points.num_rows:
            return shape.empty_table()
        ids, qids = points.column("id").to_numpy(), queries.column("qid").to_numpy()
        x, q = _matrix(points.column("v")), _matrix(queries.column("qv"))
        own, other = (x * x).sum(1), (q * q).sum(1)
        slack = 1e-11 * x.shape[1] * (other + own.max())  # more than a product of doubles can be wrong
        out: list[tuple] = []
        few = max(1, CELLS // len(ids))
        for a in range(0, len(qids), few):
            rough = other[a : a + few, None] + own[None, :] - 2 * q[a : a + few] @ x.T
            if same:
                rough[qids[a : a + few, None] == ids[None, :]] = np.inf  # a point is not its own neighbour
            for i, line in enumerate(rough, a):
                at = np.flatnonzero(line < np.inf)
                if len(at) > k:
                    at = np.flatnonzero(line <= np.partition(line, k - 1)[k - 1] + 2 * slack[i])
                d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                best = np.lexsort((ids[at], d))[:k]
                out.append((np.full(len(best), qids[i]), ids[at[best]], d[best]))
        return pa.table([np.concatenate([o[j] for o in out]) for j in range(3)], schema=shape)
    return run


def _tiles(points: int, queries: int, k: int) -> tuple[int, int]:
    """Tiles of both sides: as few as give TASKS tasks, or as their most rows ask for.

    A point goes to all tiles of queries; a query, and k answers to it, to all tiles of points. The
    shares keep the sum of both small, an answer taken as a tenth of a vector.
    """
    q = math.ceil(math.sqrt(TASKS * queries / max(points, 1) * (1 + k / 10)))
    q = max(1, math.ceil(queries / QUERIES), min(q, math.ceil(queries / LEAST)))
    return max(1, math.ceil(points / POINTS), min(math.ceil(TASKS / q), math.ceil(points / (4 * LEAST)))), q


def nearest(points: DataFrame, queries: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(qid, id, d, rank) with rank 1..k, ties to the smaller id. Inputs have columns ``id`` and ``v`` (array of double).

    ``same`` says that both are the same table, so a point never matches itself.
    """
    p_tiles, q_tiles = _tiles(points.count(), queries.count(), k)

    def dealt(column: str, tiles: int):
        return F.pmod(F.xxhash64(column), F.lit(tiles)).cast("int")

    def every(tiles: int):
        return F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))

    p = points.select("id", "v", dealt("id", p_tiles).alias("pt"), every(q_tiles).alias("qt"))
    q = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"), dealt("id", q_tiles).alias("qt"), every(p_tiles).alias("pt"))
    found = q.groupBy("qt", "pt").cogroup(p.groupBy("qt", "pt")).applyInArrow(_best(k, same), "qid long, id long, d double")
    w = Window.partitionBy("qid").orderBy("d", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in parts of at most so many rows, cut at the median of the widest column again and again."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
        else:
            order, half = np.argpartition(x[rows, x[rows].var(0).argmax()], len(rows) // 2), len(rows) // 2
            todo += [rows[order[half:]], rows[order[:half]]]
    return out


class _Held:
    """The k nearest points so far of one tile of queries, while all points come by in batches.

    A part of a batch meets the queries whose k-th nearest is farther than the part's box. Single precision finds what
    may be among the nearest, by a bound that holds for its rounding; this is measured again exactly. Finds of a
    block of queries wait until there are enough to be merged.
    """
    BLOCK, LEAF, PAIRS = 256, 1024, 1 << 19

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, same: bool):
        order = np.concatenate(_leaves(q, self.BLOCK))
        self.qids, self.q, self.k, self.same = qids[order], q[order], k, same
        m = len(qids)
        self.centre = q.mean(0)
        self.moved = self.q - self.centre
        self.own = (self.moved * self.moved).sum(1)
        # a one for the points' lengths; products of a multiple of eight terms are the fastest
        self.blank = -(q.shape[1] + 1) % 8
        self.left = np.hstack([self.moved, np.ones((m, 1 + self.blank))])
        self.single = self.left.astype(np.float32) if self.own.max() < 1e30 else None
        self.d, self.id = np.full((m, k), np.inf), np.full((m, k), np.iinfo(np.int64).max)
        self.s, self.n = np.zeros((m, k)), np.full((m, k), -1, np.int32)
        self.bound = np.full(m, np.inf)  # no lower than the distance of the k-th nearest
        self.starts, self.rooms = range(0, m, self.BLOCK), {}
        self.waiting: dict[int, list] = {a: [] for a in self.starts}

    def room(self, kind, rows: int, columns: int) -> np.ndarray:
        """Memory for a block's distances or marks, taken once."""
        if len(self.rooms.get(kind, ())) < rows * columns:
            self.rooms[kind] = np.empty(rows * columns, kind)
        return self.rooms[kind][: rows * columns].reshape(rows, columns)

    def meet(self, ids: np.ndarray, x: np.ndarray, s: np.ndarray, n: np.ndarray) -> None:
        found, pairs = [], 0
        for part in _leaves(x, len(x) if np.isinf(self.bound).any() else self.LEAF) if len(x) else []:
            for rows, at, d in self.near(ids[part], x[part]):
                at = part[at]
                found.append((rows, d, ids[at], s[at], n[at]))
                pairs += len(rows)
                if pairs >= self.PAIRS:
                    self.keep(found)
                    found, pairs = [], 0
        if found:
            self.keep(found)

    def keep(self, found: list) -> None:
        rows, *more = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        ends = np.searchsorted(rows, [*self.starts, len(self.q)])
        for a, one, two in zip(self.starts, ends, ends[1:]):
            if one < two:
                self.waiting[a].append((rows[one:two] - a, *(c[order[one:two]] for c in more)))
                if sum(len(w[0]) for w in self.waiting[a]) >= self.k * self.BLOCK // 2:
                    self.merge(a)

    def near(self, ids: np.ndarray, x: np.ndarray):
        """(query, point, distance) of all pairs within the bounds, by blocks of queries."""
        moved = x - self.centre
        own = (moved * moved).sum(1)
        gap = np.maximum(moved.min(0) - self.moved, self.moved - moved.max(0))
        np.maximum(gap, 0, out=gap)
        met = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= self.bound ** 2 * (1 + 1e-6) + 1e-12 * (self.own + own.max()))
        left = self.left if self.single is None or own.max() >= 1e30 else self.single
        kind = left.dtype.type
        c = 4 * (x.shape[1] + 8) * float(np.finfo(kind).eps)  # twice what a product can be wrong, as a share of both lengths
        right = np.vstack([(-2 * moved).T, own * (1 - c), np.zeros((self.blank, len(x)))]).astype(kind)
        for a in range(0, len(met), self.BLOCK):
            rows = met[a : a + self.BLOCK]
            rough = np.matmul(left[rows], right, out=self.room(kind, len(rows), len(ids)))  # without the query's own length
            if self.same:
                rough[self.qids[rows, None] == ids[None, :]] = np.inf  # a point is not its own neighbour
            close = self.close(rough, rows, c, kind)
            if len(ids) >= self.k and np.count_nonzero(close) > self.k * len(rows):  # no bounds yet, or far ones
                some = np.argpartition(rough, self.k - 1, axis=1)[:, : self.k]
                d = np.sqrt(((x[some] - self.q[rows][:, None, :]) ** 2).sum(2))
                d[np.isinf(np.take_along_axis(rough, some, 1))] = np.inf
                self.bound[rows] = np.minimum(self.bound[rows], d.max(1))
                close = self.close(rough, rows, c, kind)
            hits = np.flatnonzero(close & (rough < np.inf) if self.same else close)
            if len(hits):
                i, j = np.divmod(hits, len(ids))
                yield rows[i], j, np.sqrt(((x[j] - self.q[rows[i]]) ** 2).sum(1))

    def close(self, rough: np.ndarray, rows: np.ndarray, c: float, kind) -> np.ndarray:
        most = (self.bound[rows] ** 2 * (1 + 1e-6) - self.own[rows] * (1 - c)).astype(kind)
        return np.less_equal(rough, most[:, None], out=self.room(bool, *rough.shape))

    def merge(self, a: int) -> None:
        """The k best of a block's nearest so far and its waiting finds, ties to the smaller id."""
        if not self.waiting[a]:
            return
        i, *more = (np.concatenate(c) for c in zip(*self.waiting[a]))
        self.waiting[a] = []
        order, k = np.argsort(i, kind="stable"), self.k
        i = i[order]
        counts = np.bincount(i, minlength=len(self.own[a : a + self.BLOCK]))
        place = k + np.arange(len(i)) - (np.cumsum(counts) - counts)[i]
        held = [self.d, self.id, self.s, self.n]
        wide = []
        for old, new, blank in zip(held, more, (np.inf, np.iinfo(np.int64).max, 0, -1)):
            both = np.full((len(counts), k + counts.max()), blank, old.dtype)
            both[:, :k] = old[a : a + self.BLOCK]
            both[i, place] = new[order]
            wide.append(both)
        d, ids = wide[:2]
        best = np.argpartition(d, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(d, best, 1).max(1)
        for r in np.flatnonzero(((d <= last[:, None]).sum(1) > k) & (last < np.inf)):
            best[r] = np.lexsort((ids[r], d[r]))[:k]
        for old, both in zip(held, wide):
            old[a : a + self.BLOCK] = np.take_along_axis(both, best, 1)
        self.bound[a : a + self.BLOCK] = np.minimum(self.bound[a : a + self.BLOCK], last)

    def votes(self) -> pa.RecordBatch:
        """(id, p) of the queries that have a labelled neighbour; rows of one id are one query."""
        for a in self.starts:
            self.merge(a)
        ids, first, which = np.unique(self.qids, return_index=True, return_inverse=True)
        s, n = self.s[first], self.n[first]
        if len(ids) < len(self.qids):
            for g in np.flatnonzero(np.bincount(which) > 1):
                rows = which == g
                best = np.lexsort((self.id[rows].ravel(), self.d[rows].ravel()))[: self.k]
                s[g], n[g] = self.s[rows].ravel()[best], self.n[rows].ravel()[best]
        total, some = np.where(n > 0, n, 0).sum(1), (n >= 0).any(1)
        share = np.where(n > 0, s, 0).sum(1) / np.maximum(total, 1)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(share[some], mask=total[some] == 0)], names=["id", "p"])


def _votes(k: int, same: bool):
    """One task: queries of a tile (place 0), then all points."""
    def run(batches):
        asked, held = [], None
        for batch in batches:
            if batch.column("v").null_count:
                raise ValueError("a null vector")
            v = np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
            known = np.isfinite(v).all(1)  # others are near nothing
            if not known.all():
                batch, v = batch.filter(pa.array(known)), v[known]
            place, ids = batch.column("place").to_numpy(), batch.column("id").to_numpy()
            cut = int(np.searchsorted(place, 1))
            if cut:
                asked.append((ids[:cut], v[:cut]))
            if cut < len(ids) and asked:
                held = held or _Held(*(np.concatenate(c) for c in zip(*asked)), k, same)
                held.meet(ids[cut:], v[cut:], *(batch.column(c).to_numpy()[cut:] for c in ("s", "n")))
        if held:
            yield held.votes()
    return run


def _vote_tiles(spark, queries: int) -> int:
    """Tiles of queries: all points go to each. As few as give TASKS or the session's tasks, or as their most rows ask for."""
    least = min(max(TASKS // 3, spark.sparkContext.defaultParallelism), math.ceil(queries / LEAST))
    return max(1, math.ceil(queries / VOTERS), least)


def _places(points: DataFrame) -> Column:
    """1 for a sixteenth of the points, drawn by a hash, then numbers that neighbours mostly share: a bit for each leading column."""
    middle = points.agg(*[F.percentile_approx(F.get("v", F.lit(i)), 0.5, 1000).alias(f"m{i}") for i in range(12)]).first()
    code = F.lit(0)
    for i, m in enumerate(middle):
        if m is not None:
            code = code * 2 + F.when(F.get("v", F.lit(i)) > m, 1).otherwise(0)
    return F.when(F.pmod(F.xxhash64("id", F.lit("first")), F.lit(16)) == 0, 1).otherwise(code + 2)


def vote(points: DataFrame, labels: DataFrame, queries: DataFrame, k: int = 200, same: bool = False) -> DataFrame:
    """(id, p): share of positive labels among the k nearest points; labels has id and y.

    A task holds a tile of queries with the k nearest so far, and all points come by: first a sample that gives bounds,
    then the rest by place, so that a part with a small box can be left out where no query may have a neighbour in it.
    No list of neighbours is shuffled; the labels of a point's id come with it as their sum and number (-1: no label row).
    """
    tiles = _vote_tiles(points.sparkSession, queries.count())
    known = labels.groupBy("id").agg(F.sum(F.col("y").cast("double")).alias("s"), F.count("y").cast("int").alias("n"))
    weighed = points.select("id", "v").join(known.hint("merge"), "id", "left").select(
        _places(points).alias("place"), F.col("id").cast("long").alias("id"), "v",
        F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(-1)).alias("n"))
    asked = queries.select(
        F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("place"),
        F.col("id").cast("long").alias("id"), "v", F.lit(0.0).alias("s"), F.lit(-1).alias("n"))
    every = weighed.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "place", "id", "v", "s", "n")
    dealt = asked.unionByName(every).repartitionById(tiles, F.col("tile")).sortWithinPartitions("place")
    return dealt.select("place", "id", "v", "s", "n").mapInArrow(_votes(k, same), "id long, p double")
