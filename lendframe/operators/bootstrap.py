"""Bootstrap intervals with Poisson(1) weights drawn from the row key, all replicates in one pass.

A row's weight in a replicate depends on its key, the replicate and the seed only. Replicate 0 gives
every row the weight 1: it is the estimate. Rows are never multiplied by the replicates: they are
shuffled once into slices of the score, and a kernel keeps one sum per replicate while it walks
through a slice. Slices are added up in order of the score, in a tree, so nothing but a few short
arrays meets in one task. A score that many rows hold is a slice of its own, dealt out in chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.hashing import POISSON1, hex_int, poisson1, seeded_hash
from lendframe.operators.ranking import ACCURACY, with_bucket
from lendframe.session import width

#: Rows whose weights are drawn together, chunks of a common score, and slices added up in one task.
ROWS, CHUNKS, FAN = 1024, 64, 64
GOLDEN = 0x9E3779B9
STEPS = np.array([int(np.ceil(c * 2**32)) for c in POISSON1], np.uint32)
LOSSES = ("brier", "log_loss")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 32-bit numbers; every step can be undone, so different numbers stay different."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def weights(h0: np.ndarray, h1: np.ndarray, n_boot: int) -> np.ndarray:
    """Rows x replicates 0..n_boot: Poisson(1) counts, 1 in replicate 0."""
    replicate = np.arange(n_boot + 1, dtype=np.uint32) * np.uint32(GOLDEN)
    u = _mixed(_mixed(h0[:, None].astype(np.uint32) + replicate) ^ h1[:, None].astype(np.uint32))
    out = np.zeros(u.shape, np.uint8)
    for step in STEPS:
        out += u >= step
    out[:, 0] = 1
    return out


def hashes(key: str, seed) -> list[Column]:
    """Two 32-bit numbers of a row's key."""
    text = seeded_hash(F.col(key), seed)
    return [hex_int(text).alias("h0"), hex_int(text, 9).alias("h1")]


def _drawn(batch: pa.RecordBatch, n_boot: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for a in range(0, batch.num_rows, rows):
        part = batch.slice(a, rows)
        yield part, weights(part.column("h0").to_numpy(), part.column("h1").to_numpy(), n_boot)


def _arrays(slices: list, *columns: list) -> pa.RecordBatch:
    names = [f"s{i}" for i in range(len(columns))]
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), *(pa.array([x.tolist() for x in c], pa.list_(pa.float64())) for c in columns)],
                                      names=["slice", *names])


# ---------------------------------------------------------------- rank metric
class _Walk:
    """Sums of one slice, from its lowest score up: positives, negatives and pairs in the right order, a replicate each."""

    def __init__(self, n: int):
        self.pos, self.neg, self.pairs = np.zeros(n), np.zeros(n), np.zeros(n)
        self.score, self.pos_at, self.neg_at = None, np.zeros(n), np.zeros(n)

    def close(self) -> None:
        """The rows of one score are complete: pairs with equal scores count one half."""
        self.pairs += self.pos_at * (self.neg + self.neg_at / 2)
        self.pos += self.pos_at
        self.neg += self.neg_at
        self.pos_at, self.neg_at = np.zeros_like(self.pos), np.zeros_like(self.neg)

    def add(self, score: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        if self.score is not None and score[0] != self.score:
            self.close()
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        bad = np.add.reduceat(w * y[:, None], first, axis=0, dtype=float)
        good = np.add.reduceat(w * (1 - y)[:, None], first, axis=0, dtype=float)
        bad[0] += self.pos_at
        good[0] += self.neg_at
        if len(first) > 1:  # all scores but the last are complete
            below = np.cumsum(good[:-1], axis=0) - good[:-1] + self.neg
            self.pairs += (bad[:-1] * (below + good[:-1] / 2)).sum(0)
            self.pos += bad[:-1].sum(0)
            self.neg += good[:-1].sum(0)
        self.pos_at, self.neg_at, self.score = bad[-1], good[-1], score[-1]


def _walked(n_boot: int, rows: int):
    """Rows sorted by slice, chunk and score -> the sums of every slice and chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, walk = None, None
        for batch in batches:
            for part, w in _drawn(batch, n_boot, rows):
                keys = np.stack([part.column(c).to_numpy() for c in ("slice", "chunk")])
                score, y = part.column("score").to_numpy(), part.column("y").to_numpy().astype(np.uint8)
                edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
                for a, b in zip(edges, np.append(edges[1:], len(score))):
                    here = tuple(keys[:, a].tolist())
                    if here != place:
                        if walk is not None:
                            walk.close()
                            yield _arrays([place[0]], [walk.pos], [walk.neg], [walk.pairs])
                        place, walk = here, _Walk(n_boot + 1)
                    walk.add(score[a:b], y[a:b], w[a:b])
        if walk is not None:
            walk.close()
            yield _arrays([place[0]], [walk.pos], [walk.neg], [walk.pairs])
    return run


def _stacked(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    at = table.column("slice").to_numpy()
    order = np.argsort(at, kind="stable")
    return at[order], [np.array(table.column(f"s{i}").combine_chunks().flatten()).reshape(len(at), -1)[order]
                       for i in range(table.num_columns - 1)]


def _in_order(key, table):
    """Adds up slices from the lowest score up. Chunks of one slice hold one and the same score."""
    at, (pos, neg, pairs) = _stacked(table)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    chunks = np.diff(np.append(first, len(at)))
    pos, neg, pairs = (np.add.reduceat(x, first, axis=0) for x in (pos, neg, pairs))
    pairs[chunks > 1] = pos[chunks > 1] * neg[chunks > 1] / 2
    below = np.cumsum(neg, axis=0) - neg
    return pa.Table.from_batches([_arrays([key[0].as_py()], [pos.sum(0)], [neg.sum(0)], [(pairs + pos * below).sum(0)])])


def _summed(key, table):
    _, sums = _stacked(table)
    return pa.Table.from_batches([_arrays([key[0].as_py()], *([x.sum(0)] for x in sums))])


def _tree(parts: DataFrame, top: int, merge) -> DataFrame:
    """FAN slices at a time, until one row is left."""
    while True:
        parts = parts.groupBy((F.col("slice") / FAN).cast("long")).applyInArrow(merge, parts.schema)
        if top < FAN:
            return parts
        top //= FAN


def _shape(columns: int) -> str:
    return "slice long, " + ", ".join(f"s{i} array<double>" for i in range(columns))


def auc_replicates(df: DataFrame, key: str, y: str, p: str, n_boot: int = 1000, seed=42) -> DataFrame:
    """rep (0: the rows as they are), value: the area under the ROC curve; NULL with one class only. One shuffle of the rows."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(
        F.col(p).cast("double").alias("score"), F.col(y).cast("int").alias("y"), *hashes(key, seed))
    slices = width(df.sparkSession)
    found = rows.agg(F.percentile_approx("score", [i / slices for i in range(1, slices)], ACCURACY).alias("e")).first()["e"] or []
    edges = sorted(set(found))
    common = [e for e in edges if found.count(e) > 1]  # held by at least one slice's share of the rows
    rows = with_bucket(rows, "score", edges, "bucket")
    is_common = F.col("score").isin(common) if common else F.lit(False)
    placed = rows.select("score", "y", "h0", "h1", (2 * F.col("bucket") + (~is_common).cast("int")).cast("long").alias("slice"),
                         F.when(is_common, F.col("h1") % CHUNKS).otherwise(0).cast("long").alias("chunk"))
    placed = placed.repartition("slice", "chunk").sortWithinPartitions("slice", "chunk", "score")
    total = _tree(placed.mapInArrow(_walked(n_boot, ROWS), _shape(3)), 2 * len(edges) + 1, _in_order)
    each = total.select(F.posexplode(F.arrays_zip("s0", "s1", "s2")).alias("rep", "v"))
    return each.select("rep", F.when((F.col("v.s0") > 0) & (F.col("v.s1") > 0),
                                     F.col("v.s2") / (F.col("v.s0") * F.col("v.s1"))).alias("value"))


# ---------------------------------------------------------------- mean losses and totals
def _totals(n_boot: int, columns: Sequence[str], rows: int):
    """Per replicate: rows kept, total weight and weighted sums of the columns, one row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 + len(columns), n_boot + 1))
        for batch in batches:
            for part, w in _drawn(batch, n_boot, rows):
                sums[0] += (w > 0).sum(0)
                sums[1] += w.sum(0, dtype=np.int64)
                for i, c in enumerate(columns):
                    sums[2 + i] += part.column(c).to_numpy() @ w
        from pyspark import TaskContext
        yield _arrays([TaskContext.get().partitionId()], *([x] for x in sums))
    return run


def replicate_totals(df: DataFrame, key: str, values: dict[str, Column] | None = None, n_boot: int = 1000, seed=42) -> DataFrame:
    """rep, rows, total and the weighted sum of every value: no shuffle of rows."""
    values = values or {}
    rows = df.select(*hashes(key, seed), *[e.cast("double").alias(f"v{i}") for i, e in enumerate(values.values())])
    names = [f"v{i}" for i in range(len(values))]
    parts = rows.mapInArrow(_totals(n_boot, names, ROWS), _shape(2 + len(names)))
    total = _tree(parts, FAN**2, _summed)  # enough for any number of partitions up to FAN ** 3
    each = total.select(F.posexplode(F.arrays_zip(*[f"s{i}" for i in range(2 + len(names))])).alias("rep", "v"))
    return each.select("rep", F.col("v.s0").cast("long").alias("rows"), F.col("v.s1").cast("long").alias("total"),
                       *[F.col(f"v.s{2 + i}").alias(n) for i, n in enumerate(values)])


def _loss(metric: str, y: str, p: str) -> Column:
    from lendframe.operators.metrics import log_loss_of
    return F.pow(F.col(p) - F.col(y), 2) if metric == "brier" else log_loss_of(y, p)


def replicates(df: DataFrame, key: str, n_boot: int, seed=42) -> DataFrame:
    """Rows times replicates that kept them: adds ``rep`` (0: all rows, weight 1) and ``w``. For metrics that
    have no kernel here; it shuffles a row per replicate."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(n_boot)), lambda r: F.struct(r.alias("rep"), F.when(r == 0, 1).otherwise(
        poisson1(F.substring(seeded_hash(F.concat_ws(":", F.col(key), r), seed), 1, 8))).alias("w")))
    return (df.withColumn("_d", F.explode(F.filter(draws, lambda d: d["w"] > 0)))
            .select(*df.columns, F.col("_d.rep").alias("rep"), F.col("_d.w").alias("w")))


def metric_replicates(df: DataFrame, key: str, y: str, scores: Sequence[str], metric: str | Callable, n_boot: int, seed) -> DataFrame:
    """rep and one value column a score, all with the same weights.

    metric: roc_auc, brier, log_loss, or any function of `operators.metrics` that takes (df, y, p, by, weight).
    """
    if callable(metric):
        drawn, out = replicates(df, key, n_boot, seed), None
        for p in scores:
            one = metric(drawn, y, p, by=["rep"], weight="w").withColumnRenamed("value", p)
            out = one if out is None else out.join(one, "rep")
        return out
    if metric in LOSSES:
        known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (y, *scores)))
        sums = replicate_totals(known, key, {p: _loss(metric, y, p) for p in scores}, n_boot, seed)
        return sums.select("rep", *[F.try_divide(F.col(p), F.col("total")).alias(p) for p in scores])
    if metric != "roc_auc":
        raise ValueError(f"metric must be roc_auc, {' or '.join(LOSSES)}")
    out = None
    for p in scores:
        one = auc_replicates(df, key, y, p, n_boot, seed).withColumnRenamed("value", p)
        out = one if out is None else out.join(one, "rep")
    return out


def _ends(ci: float) -> list[float]:
    return [(1 - ci) / 2, 1 - (1 - ci) / 2]


def bootstrap_ci(df: DataFrame, key: str, y: str, p: str, metric: str | Callable = "roc_auc", n_boot: int = 1000, ci: float = 0.95,
                 seed=42) -> DataFrame:
    """estimate, low, high, n_boot. Replicates with only one class are skipped."""
    reps = metric_replicates(df.select(key, y, p), key, y, [p], metric, n_boot, seed)
    drawn = F.when(F.col("rep") > 0, F.col(p))
    return reps.agg(F.max(F.when(F.col("rep") == 0, F.col(p))).alias("estimate"),
                    F.percentile(drawn, _ends(ci)).alias("q"), F.count(drawn).alias("n_boot")).select(
        "estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_boot")


def paired_bootstrap(df: DataFrame, key: str, y: str, a: str, b: str, metric: str | Callable = "roc_auc", n_boot: int = 1000,
                     ci: float = 0.95, seed=42) -> DataFrame:
    """Interval of metric(a) - metric(b) with the same weights for both scores."""
    reps = metric_replicates(df.select(key, y, a, b), key, y, [a, b], metric, n_boot, seed)
    gap = F.col(a) - F.col(b)
    drawn = F.when(F.col("rep") > 0, gap)
    both = reps.agg(F.max(F.when(F.col("rep") == 0, gap)).alias("difference"), F.percentile(drawn, _ends(ci)).alias("q"),
                    F.avg((drawn <= 0).cast("double")).alias("below"), F.avg((drawn >= 0).cast("double")).alias("above"))
    low, high = F.col("q")[0], F.col("q")[1]
    return both.select("difference", low.alias("low"), high.alias("high"),
                       F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p_value"),
                       ((low > 0) | (high < 0)).cast("int").alias("significant"))


def better_calibrator(df: DataFrame, key: str, y: str, raw: str, calibrated: str, n_boot: int = 1000, seed=42) -> DataFrame:
    """Keep the calibrated score only when its Brier difference lies below 0 with its interval."""
    test = paired_bootstrap(df, key, y, calibrated, raw, "brier", n_boot, seed=seed)
    return test.withColumn("chosen", F.when(F.col("high") < 0, F.lit(calibrated)).otherwise("none"))
