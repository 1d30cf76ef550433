"""Cross-validated logistic regressions on nested column sets, all fitted together.

A model is a column set with one fold left out. The table is prepared once; then one pass of a Newton
step gives every model its gradient and Hessian, so a whole ablation with five folds costs as many
passes as its slowest model has steps. What a pass returns grows with the columns, not with the rows.

Preprocessing never sees the fold left out: caps, medians, scales and target means come from the other
folds, and a row that is fitted on takes its level's mean over the folds that are neither its own nor
the one left out. Levels are looked up with a join, so there may be any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lendframe.session import fresh_folder

CAPS = (0.001, 0.5, 0.999)
MAX_ONE_HOT, SMOOTHING, FAN, ROWS = 10, 10.0, 32, 4096
#: Ranks of caps and medians are right to 1 / ACCURACY of the rows; a task holds a sketch a column and fold.
ACCURACY = 2000
#: Sketches that one task merges.
SKETCHES = 150


@dataclass
class Table:
    """The prepared rows (id, fold, y, x, h, t) and what every left-out fold needs to make inputs of them."""
    rows: DataFrame | None
    folds: list[int]
    numeric: list[str]
    flagged: list[int]  # numbers of the numeric columns with missing values
    one_hot: list[tuple[str, str | None]]
    large: list[str]
    caps: np.ndarray  # fold left out x (low, median, high) x numeric column
    prior: np.ndarray  # label mean without the fold left out and a row's own fold
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)

    @property
    def inputs(self) -> list[str]:
        """The column that each model input is made of."""
        return [*self.numeric, *(self.numeric[i] for i in self.flagged), *(c for c, _ in self.one_hot), *self.large]


def prepared(df: DataFrame, key: str, label: str, fold: str, columns: Sequence[str]) -> Table:
    """Labelled rows with numbers as one array, small text columns one-hot and large ones as sums by fold."""
    rows = _written(df.where(F.col(label).isNotNull()).select(key, label, fold, *columns), "cv-rows")  # read four times
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [c for c in columns if isinstance(types[c], StringType)]
    numeric = [c for c in columns if c not in texts]
    # two passes over the columns: what to cap and fill with, and which text columns are small
    counts = rows.groupBy(fold).agg(F.count("*").alias("n"), F.sum(label).alias("s")).orderBy(fold).collect()
    folds = [r[fold] for r in counts]
    n, s = (np.array([float(r[c]) for r in counts]) for c in ("n", "s"))
    rest = [[[i for i in range(len(folds)) if i not in (k, f)] for f in range(len(folds))] for k in range(len(folds))]
    prior = np.array([[s[r].sum() / max(n[r].sum(), 1) if r else 0.0 for r in row] for row in rest])
    holes = [F.max(F.isnull(c).cast("int")).alias(f"m{j}") for j, c in enumerate(numeric)]
    levels = [F.approx_count_distinct(c).alias(f"l{j}") for j, c in enumerate(texts)]
    found = rows.agg(F.count("*").alias("n"), *holes, *levels).first()
    caps = caps_without_a_fold(rows, fold, folds, numeric)
    large = [c for j, c in enumerate(texts) if found[f"l{j}"] > MAX_ONE_HOT]
    small = [c for c in texts if c not in large]
    seen = rows.agg(*[F.collect_set(F.coalesce(F.concat(F.lit("="), c), F.lit("?"))).alias(f"c{j}") for j, c in enumerate(small)]).first() \
        if small else []
    one_hot = [(c, None if v == "?" else v[1:]) for c, values in zip(small, seen) for v in sorted(values)]
    hot = [F.coalesce(F.col(c).eqNullSafe(F.lit(v)), F.lit(False)).cast("double") for c, v in one_hot]
    # per level: label sums and counts of every fold
    for j, c in enumerate(large):
        by = [F.coalesce(F.sum(F.when(F.col(fold) == k, F.col(label))), F.lit(0)).cast("double") for k in folds]
        many = [F.sum((F.col(fold) == k).cast("double")) for k in folds]
        table = rows.groupBy(F.col(c).alias("level")).agg(F.array(*by, *many).alias(f"t_{j}"))
        rows = rows.join(table, rows[c].eqNullSafe(table["level"]), "left").drop("level")
    none = F.array().cast("array<double>")
    out = rows.select(F.col(key).cast("long").alias("id"), F.array_position(F.array(*map(F.lit, folds)), F.col(fold)).cast("int").alias("k"),
                      F.col(label).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in numeric]).alias("x") if numeric else none.alias("x"),
                      F.array(*hot).alias("h") if hot else none.alias("h"),
                      F.concat(*[F.col(f"t_{j}") for j in range(len(large))]).alias("t") if large else none.alias("t"))
    made = Table(_written(out, "cv-inputs"), folds, numeric, [j for j in range(len(numeric)) if found[f"m{j}"]], one_hot, large, caps, prior)
    _scaled(made)
    return made


def caps_without_a_fold(rows: DataFrame, fold: str, folds: Sequence[int], numeric: Sequence[str]) -> np.ndarray:
    """Fold left out x CAPS x numeric column, zeros where the other folds hold no value.

    A part of the columns has at most SKETCHES sketches (or one column's), which a task of its own merges.
    """
    caps, parts = np.zeros((len(folds), len(CAPS), len(numeric))), []
    many = max(1, SKETCHES // max(1, len(folds)))
    for a in range(0, len(numeric), many):
        sketches = [F.percentile_approx(F.when(F.col(fold) != k, F.col(c).cast("double")), list(CAPS), ACCURACY)
                    for c in numeric[a : a + many] for k in folds]
        parts.append(rows.agg(F.array(*sketches).alias("found")).select(F.lit(a).alias("first"), "found"))
    with ThreadPoolExecutor(8) as pool:  # a union of them would be one task
        merged = list(pool.map(lambda part: part.first(), parts))
    for r in merged if folds else []:
        for i, one in enumerate(r["found"]):
            caps[i % len(folds), :, r["first"] + i // len(folds)] = one or 0.0
    return caps


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lists(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def _batches(table: Table, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield (part, part.column("k").to_numpy() - 1, part.column("y").to_numpy().astype(float), _lists(part.column("x"), len(table.numeric)),
                   _lists(part.column("h"), len(table.one_hot)), _lists(part.column("t"), 2 * len(table.folds) * len(table.large)))


def _inputs(t: Table, k: int, fold: np.ndarray, x: np.ndarray, h: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Inputs of rows for the models that leave out fold number k."""
    missing = np.isnan(x)
    low, middle, high = t.caps[k]
    z = np.where(missing, middle, np.clip(x, low, high))
    number = len(t.folds)
    use = (np.arange(number) != k) & (np.arange(number) != fold[:, None])
    rates = []
    for j in range(len(t.large)):
        one = sums[:, 2 * number * j : 2 * number * (j + 1)]
        bad, n = (one[:, :number] * use).sum(1), (one[:, number:] * use).sum(1)
        rates.append((bad + SMOOTHING * t.prior[k, fold]) / (n + SMOOTHING))
    out = np.concatenate([z, missing[:, t.flagged].astype(float), h, np.array(rates).reshape(len(t.large), len(x)).T], axis=1)
    return out if t.mean is None else (out - t.mean[k]) / t.scale[k]


def _moments(t: Table):
    t = replace(t, rows=None)  # goes to the tasks

    def run(batches):
        d = len(t.inputs)
        sums = np.zeros((len(t.folds), 2 * d + 1))
        for _, fold, _, x, h, s in _batches(t, batches):
            for k in range(len(t.folds)):
                mine = fold != k
                z = _inputs(t, k, fold[mine], x[mine], h[mine], s[mine])
                sums[k] += np.concatenate([z.sum(0), (z * z).sum(0), [len(z)]])
        yield named_rows([f"{k}" for k in range(len(t.folds))], list(sums))
    return run


def named_rows(names: list[str], values: list[np.ndarray]) -> pa.RecordBatch:
    from pyspark import TaskContext
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), TaskContext.get().partitionId()), pa.int64()),
                                       pa.array([v.tobytes() for v in values], pa.binary())], names=["name", "part", "value"])


def _added(key, table):
    total = sum(np.frombuffer(v.as_py()) for v in table.column("value"))
    return pa.table({"name": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int64()), "value": pa.array([total.tobytes()], pa.binary())})


def summed(rows: DataFrame, kernel) -> dict[str, np.ndarray]:
    """Adds up what the tasks return, in a tree; one array a name comes to the driver, of a size set by the columns."""
    shape = "name string, part long, value binary"
    parts = rows.mapInArrow(kernel, shape)
    for _ in range(2):
        parts = parts.withColumn("part", (F.col("part") / FAN).cast("long")).groupBy("name", "part").applyInArrow(_added, shape)
    out: dict[str, np.ndarray] = {}
    for r in parts.collect():
        one = np.frombuffer(r["value"])
        out[r["name"]] = out[r["name"]] + one if r["name"] in out else one
    return out


def _scaled(t: Table) -> None:
    """Mean and deviation of every input but the one-hot ones, for each fold left out."""
    sums, d = summed(t.rows, _moments(t)), len(t.inputs)
    mean, scale = np.zeros((len(t.folds), d)), np.ones((len(t.folds), d))
    first = len(t.numeric) + len(t.flagged)
    moved = np.ones(d, bool)
    moved[first : first + len(t.one_hot)] = False
    for k in range(len(t.folds)):
        if str(k) in sums:
            one, two, n = sums[str(k)][:d], sums[str(k)][d : 2 * d], max(sums[str(k)][-1], 1)
            deviation = np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))
            deviation[deviation <= 1e-9 * (1 + np.abs(one / n))] = 1.0
            mean[k, moved], scale[k, moved] = (one / n)[moved], deviation[moved]
    t.mean, t.scale = mean, scale


@dataclass
class Fit:
    """Coefficients (intercept last) of the models that leave out each fold, on some of the inputs."""
    use: np.ndarray
    weights: np.ndarray
    steps: int = 0
    slope: float = np.inf  # the largest part of the gradient at the end


def _newton_pass(t: Table, models: dict[str, tuple[int, np.ndarray, np.ndarray]]):
    """Loss, gradient and Hessian of every open model: name -> (fold left out, inputs, weights)."""
    t = replace(t, rows=None)  # goes to the tasks

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for _, fold, y, x, h, s in _batches(t, batches):
            for k in sorted({m[0] for m in models.values()}):
                mine = fold != k
                if not mine.any():
                    continue
                z = np.concatenate([_inputs(t, k, fold[mine], x[mine], h[mine], s[mine]), np.ones((int(mine.sum()), 1))], axis=1)
                for name, (left_out, use, w) in models.items():
                    if left_out != k:
                        continue
                    a = z[:, np.append(use, z.shape[1] - 1)]
                    logit = a @ w
                    p = 1 / (1 + np.exp(-logit))
                    loss = (np.logaddexp(0, logit) - y[mine] * logit).sum()
                    half = a * np.sqrt(p * (1 - p))[:, None]
                    one = np.concatenate([[loss], a.T @ (p - y[mine]), (half.T @ half).ravel()])
                    sums[name] = sums[name] + one if name in sums else one
        yield named_rows(list(sums), list(sums.values()))
    return run


def fit_logistic(t: Table, sets: dict[str, Sequence[str]], C: float = 0.1, max_steps: int = 25, tolerance: float = 1e-8) -> dict[str, Fit]:
    """One fit for each named column set and each fold left out: sum of log losses + |weights|^2 / 2C, intercept free.

    A step that makes a model worse is halved. A model is done when no part of its gradient is above
    tolerance times the rows.
    """
    inputs, fits, open_, before, step = t.inputs, {}, {}, {}, {}
    for name, columns in sets.items():
        chosen = set(columns)
        use = np.array([i for i, c in enumerate(inputs) if c in chosen], int)
        fits[name] = Fit(use, np.zeros((len(t.folds), len(use) + 1)))
        for k in range(len(t.folds)):
            open_[f"{name}|{k}"] = (k, use, np.zeros(len(use) + 1))
    slopes = dict.fromkeys(open_, np.inf)
    rows = t.rows.count()
    for _ in range(max_steps):
        found = summed(t.rows, _newton_pass(t, open_))
        for model in list(open_):
            k, use, w = open_[model]
            fit, d = fits[model.rsplit("|", 1)[0]], len(w)
            got = found[model]
            penalty = np.append(np.full(d - 1, 1 / C), 0.0)
            loss = got[0] + 0.5 * (penalty * w * w).sum()
            if model in before and loss > before[model][0] + 1e-9 * abs(loss):
                step[model] = step[model] / 2  # too far: half the way from the last good point
                open_[model] = (k, use, before[model][1] - step[model])
                continue
            gradient = got[1 : d + 1] + penalty * w
            slopes[model] = float(np.abs(gradient).max())
            fit.weights[k], fit.steps = w, fit.steps + 1
            fit.slope = max(slopes[f"{model.rsplit('|', 1)[0]}|{j}"] for j in range(len(t.folds)))
            if slopes[model] <= tolerance * rows:
                del open_[model]
                continue
            before[model] = (loss, w)
            hessian = got[d + 1 :].reshape(d, d) + np.diag(penalty + 1e-12)
            step[model] = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            open_[model] = (k, use, w - step[model])
        if not open_:
            break
    return fits


def _scores(t: Table, fits: dict[str, Fit]):
    t = replace(t, rows=None)  # goes to the tasks

    def run(batches):
        for part, fold, _, x, h, s in _batches(t, batches):
            p = np.zeros((len(fold), len(fits)))
            for k in range(len(t.folds)):
                mine = fold == k
                if mine.any():
                    z = _inputs(t, k, fold[mine], x[mine], h[mine], s[mine])
                    for j, fit in enumerate(fits.values()):
                        p[mine, j] = 1 / (1 + np.exp(-(z[:, fit.use] @ fit.weights[k, :-1] + fit.weights[k, -1])))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.array(t.folds)[fold], pa.int32()), part.column("y"),
                                              *(pa.array(p[:, j]) for j in range(len(fits)))],
                                             names=["id", "fold", "y", *(f"p{j}" for j in range(len(fits)))])
    return run


def out_of_fold(t: Table, fits: dict[str, Fit]) -> DataFrame:
    """id, fold, y and one column of out-of-fold scores for each named fit."""
    shape = "id long, fold int, y int, " + ", ".join(f"p{j} double" for j in range(len(fits)))
    scored = t.rows.mapInArrow(_scores(t, fits), shape)
    return scored.select("id", "fold", "y", *[F.col(f"p{j}").alias(n) for j, n in enumerate(fits)])
