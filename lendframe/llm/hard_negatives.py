"""Hard-negative mining by threshold joins over a pruned inverted index.

A join finds, for every anchor, all rows whose inner product reaches the anchor's threshold. Rows and
anchors lie in tiles. In a tile, dimensions are put in order of their energy and cut into strips. A
strip lists a row only up to the strip from which the norm of the row's rest, times that of any anchor's
rest, stays below the anchor's threshold: what is left of the row is covered by that bound and not in the
index. Partial scores are added up strip by strip; a row is dropped for an anchor as soon as its partial
score and the product of the norms left can't reach the threshold. The rows that stay get their exact score.

Thresholds start high and are lowered for those anchors only whose windows are not full yet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm.tables import written

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: A negative's score lies between these parts of 100 of the positive's score.
LOW, HIGH = 30, 90
#: First thresholds for positives, as parts of the product of the anchor's norm and the middle norm of all rows.
STARTS = (0.35, 0.2)
#: Steps from the top of a window (1) down to its end (0).
STEPS = (0.9, 0.6, 0.0)
ROWS_TILE, ANCHORS_TILE, STRIP = 2048, 1024, 8


class Index:
    """The inverted index of a tile's rows for thresholds of some anchors.

    Strip s holds the values of the dimensions s * STRIP and on, for the rows listed there; rows are
    sorted by how many strips list them, so a strip's list is a beginning of the rows.
    """

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, thresholds: np.ndarray):
        width = rows.shape[1]
        dims = np.argsort(-(rows.astype(float) ** 2).sum(0), kind="stable")
        self.anchors = anchors[:, dims]
        strips = max(1, math.ceil(width / STRIP))
        self.cuts = [slice(s * STRIP, min(width, (s + 1) * STRIP)) for s in range(strips)]
        rest = _rest(rows[:, dims], self.cuts)
        self.anchor_rest = _rest(self.anchors, self.cuts)
        # what an anchor's rest can add to a row's rest of norm 1, against the threshold it has to reach
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(self.anchor_rest > 0, thresholds[:, None] / self.anchor_rest, np.where(thresholds[:, None] > 0, np.inf, 0))
        reach = reach.min(0, initial=np.inf) * (1 - 1e-9)  # bounds are kept safe against rounding
        covered = rest < np.maximum(reach, 0)
        listed = np.where(covered.any(1), covered.argmax(1), strips)
        self.order = np.argsort(-listed, kind="stable")
        self.listed = listed[self.order]
        self.sizes = [int(np.count_nonzero(listed > s)) for s in range(strips)]
        self.rows, self.rest = rows[:, dims][self.order], rest[self.order]
        self.postings = [self.rows[:n, cut] for n, cut in zip(self.sizes, self.cuts)]
        self.touched = 0  # row and anchor pairs times strips that were multiplied

    def reaching(self, i: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (as given) and scores that reach a threshold for anchor i."""
        q, left = self.anchors[i], self.anchor_rest[i]
        alive = np.arange(self.sizes[0])
        score = np.zeros(len(alive), self.rows.dtype)
        done = np.zeros(len(alive), np.int64)
        for s, (listed, cut) in enumerate(zip(self.sizes, self.cuts)):
            inside = int(np.searchsorted(alive, listed))  # a strip lists the first of the rows
            if not inside:
                break
            some = alive[:inside]
            part = self.postings[s][:listed] if inside == listed else self.postings[s][some]
            score[:inside] += part @ q[cut]
            done[:inside] = s + 1
            self.touched += inside
            best = score + self.rest[alive, done] * left[done]
            keep = best >= threshold - 1e-9 * (abs(threshold) + np.abs(best)) - 1e-6
            if not keep.all():
                alive, score, done = alive[keep], score[keep], done[keep]
        for s in np.unique(done):  # the dimensions that the index left out
            more = done == s
            if s < len(self.cuts):
                score[more] += self.rows[alive[more], s * STRIP :] @ q[s * STRIP :]
        found = score >= threshold if score.dtype == np.int64 else score >= float(threshold)
        return self.order[alive[found]], score[found]


def _rest(x: np.ndarray, cuts: list[slice]) -> np.ndarray:
    """The norm of each row from each strip on; behind the last strip 0."""
    parts = np.stack([(x[:, c].astype(float) ** 2).sum(1) for c in cuts], 1)
    return np.sqrt(np.concatenate([np.cumsum(parts[:, ::-1], 1)[:, ::-1], np.zeros((len(x), 1))], 1))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    many = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), many)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = lists.flatten().to_numpy()
    return out


def _whole_numbers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles while products of them are exact, else 64-bit integers."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return a, b
    return a.astype(np.int64), b.astype(np.int64)


def _join(same: bool, k: int):
    """Kernel over the asked windows and the rows of a tile: the k best rows of each window that reach its floor."""
    shape = pa.schema([("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return shape.empty_table()
        width = max(1, *(int(t.column("v").combine_chunks().value_lengths().to_numpy().max(initial=0)) for t in (asked, rows)))
        ids = rows.column("vec_id").to_numpy()
        by_id = np.argsort(ids, kind="stable")
        ids, labels = ids[by_id], rows.column("label").to_numpy()[by_id]
        x, q = _whole_numbers(_matrix(rows.column("v"), width)[by_id], _matrix(asked.column("v"), width))
        anchor, label = asked.column("anchor_id").to_numpy(), asked.column("label").to_numpy()
        windows = asked.column("windows").to_pylist()
        floors = [min(w["floor"] for w in ws) for ws in windows]
        index = Index(x, q, np.array(floors, float))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, ws in enumerate(windows):
            at, score = index.reaching(i, floors[i])
            fits = (ids[at] != anchor[i]) & ((labels[at] == label[i]) if same else (labels[at] != label[i]))
            at, score = at[fits], score[fits]
            best = np.lexsort((at, -score))  # rows are in order of their ids
            at, score = at[best], score[best].astype(np.int64)
            for w in ws:
                pick = np.flatnonzero((score >= w["floor"]) & (score <= w["top"]))[:k]
                out.append((w["window"], ids[at[pick]], score[pick]))
        many = [len(o[1]) for o in out]
        return pa.table([np.repeat(np.array([o[0] for o in out], np.int64), many), np.concatenate([o[1] for o in out]),
                         np.concatenate([o[2] for o in out])], schema=shape)
    return run


def _search(rows: DataFrame, asked: DataFrame, tiles: int, same: bool, k: int, floors: list[Column], name: str) -> DataFrame:
    """window, rank, vec_id, score: the k best rows of each window.

    asked: window, anchor_id, label, v, end (no score below it is wanted), top. floors: the thresholds,
    one for each round; after the last one every window is at its end.
    """
    spark = rows.sparkSession
    found, done = [], None
    for r, floor in enumerate(floors):
        left = asked if done is None else asked.join(done, "window", "left_anti")
        left = left.withColumn("floor", F.greatest(floor.cast("long"), F.col("end")))
        window = F.struct("window", "floor", "top")
        # anchors with a threshold of zero or less need the whole index: they stand in tiles of their own
        groups = left.groupBy("anchor_id", "label", "v", (F.col("floor") > 0).alias("pruned")).agg(F.collect_list(window).alias("windows"))
        groups = written(groups, f"{name}-asked-{r}")
        blocks = {kind: math.ceil(n / ANCHORS_TILE) for kind, n in groups.groupBy("pruned").count().collect()}
        if not blocks:
            break
        pruned, rest = blocks.get(True, 0), blocks.get(False, 0)
        place = F.xxhash64("anchor_id")
        block = F.when(F.col("pruned"), F.pmod(place, F.lit(max(1, pruned)))).otherwise(pruned + F.pmod(place, F.lit(max(1, rest))))
        groups = groups.withColumn("s", block.cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        copies = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(pruned + rest - 1))))
        entries = groups.groupBy("s", "t").cogroup(copies.groupBy("s", "t")).applyInArrow(_join(same, k), "window long, vec_id long, score long")
        best = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id")
        entries = entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ends = left.select("window", (F.col("floor") <= F.col("end")).alias("over"))
        full = F.count("*").over(Window.partitionBy("window")) == k
        entries = written(entries.join(ends, "window").withColumn("whole", F.col("over") | full), f"{name}-{r}")
        found.append(entries.where("whole").select("window", "rank", "vec_id", "score"))
        now = entries.where("whole").select("window").distinct()
        done = now if done is None else done.unionByName(now)
    if not found:
        return spark.createDataFrame([], "window long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_rank, positive_id, positive_score, rank, negative_id, negative_score.

    Components become floor(scale * x); a score is the integer inner product with the anchor. The
    positives of an anchor are its `positives` best other rows of its label, the negatives of a positive
    the `negatives` best rows of other labels with low * positive <= 100 * negative <= high * positive.
    Ties go to the smaller id. Rows with a null id, a null label, a null vector or a null or non-finite
    component take no part. Shorter vectors are filled with zeros. Rows with the anchor's id are its own;
    other repeated rows count as often as they come. An anchor id that occurs more than once is asked once,
    with its least label and vector. `anchor` is a condition on the columns of `vectors`. No rows give no rows.
    Scores below 2**63 are exact.
    """
    ok = F.forall("v", lambda e: F.coalesce(e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf), F.lit(False)))
    x = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("long").alias("label"),
                       vectors[vec_col].cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asked"))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ok)
    tiles = max(1, math.ceil(x.count() / ROWS_TILE))
    # written, so that a row's random tile stays the same
    x = written(x.select("vec_id", "label", F.transform("v", lambda e: F.floor(e * scale).cast("double")).alias("v"), "asked",
                         F.floor(F.rand(5) * tiles).cast("int").alias("t")), "vectors")
    rows = x.drop("asked")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))
    middle = x.agg(F.percentile_approx(norm, 0.5).alias("m")).first()["m"] or 0.0
    anchors = x.where("asked").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = anchors.select(F.col("vec_id").alias("window"), F.col("vec_id").alias("anchor_id"), "a.label", "a.v")
    everything = F.lit(-(2**63))
    asked = anchors.withColumn("end", everything).withColumn("top", F.lit(2**63 - 1))
    near = _search(rows, asked, tiles, True, positives, [*(F.floor(norm * part * middle) for part in STARTS), everything], "positives")
    near = near.select(F.col("window").alias("anchor_id"), F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"),
                       F.col("score").alias("positive_score"))
    # numbers of windows: written, so that they stay the same
    near = near.join(anchors.drop("window"), "anchor_id").withColumn("window", F.monotonically_increasing_id())
    near = written(near, "windows")
    # decimals keep the bounds exact
    part = F.col("positive_score").cast("decimal(30,0)")
    asked = near.select("window", "anchor_id", "label", "v", F.ceil(part * low / 100).cast("long").alias("end"),
                        F.floor(part * high / 100).cast("long").alias("top")).where(F.col("end") <= F.col("top"))
    span = F.col("top") - F.col("end")
    far = _search(rows, asked, tiles, False, negatives, [F.col("end") + F.floor(span * step) for step in STEPS], "negatives")
    far = far.select("window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.drop("label", "v").join(far, "window").drop("window")
