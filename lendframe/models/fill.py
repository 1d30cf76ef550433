"""How well a missing number can be guessed from other columns: every candidate from one aggregate.

The rows of each fold give one table of products of all columns. Means, scales, the least squares and
ridge weights for any penalty, the errors of cross-validation and those on the fold kept for checking
are all computed from these tables, whose size depends on the columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.models.joint_cv import ACCURACY, named_rows, summed
from lendframe.operators.quantiles import fitted_quantiles

#: Penalties tried, evenly spaced in the logarithm.
PENALTIES = tuple(10 ** (k / 2) for k in range(-4, 9))


def _products(width: int):
    """Per fold: products of (1, inputs, target) summed over the rows."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.asarray(batch.column("z").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
            folds = batch.column("fold").to_numpy()
            for k in np.unique(folds):
                part = z[folds == k]
                one = (part.T @ part).ravel()
                sums[str(k)] = sums[str(k)] + one if str(k) in sums else one
        yield named_rows(list(sums), list(sums.values()))
    return run


class _Gram:
    """Products of some folds: count, means, and the standardised system."""

    def __init__(self, g: np.ndarray):
        self.g, self.n = g, g[0, 0]
        mean = g[0] / self.n
        spread = g / self.n - np.outer(mean, mean)
        self.mean, self.scale = mean[1:-1], np.sqrt(np.maximum(np.diag(spread)[1:-1], 0))
        self.scale[self.scale <= 1e-9 * (1 + np.abs(self.mean))] = 1.0
        self.target = mean[-1]
        self.xx = self.n * spread[1:-1, 1:-1] / np.outer(self.scale, self.scale)
        self.xy = self.n * spread[1:-1, -1] / self.scale

    def weights(self, penalty: float) -> np.ndarray:
        """For standardised inputs; without a penalty the shortest of the least squares solutions."""
        if penalty == 0:
            return np.linalg.pinv(self.xx, rcond=1e-12, hermitian=True) @ self.xy
        return np.linalg.solve(self.xx + penalty * np.eye(len(self.xx)), self.xy)

    def squares(self, weights: np.ndarray, check: np.ndarray) -> float:
        """Squared error on the rows of another table of products."""
        w = weights / self.scale
        line = np.concatenate([[w @ self.mean - self.target], -w, [1.0]])  # target - guess
        return float(line @ check @ line)


def fill_report(df: DataFrame, target: str, inputs: Sequence[str], fold: str = "fold", check: int = 1,
                penalties: Sequence[float] = PENALTIES) -> DataFrame:
    """method, penalty, rmse, r2, largest_weight, chosen: on the fold `check`, fitted on the others.

    Methods: the median, least squares, and ridge for every penalty; chosen marks the penalty with the
    smallest squared error in cross-validation over the fitted folds. Missing inputs become the median
    of the fitted rows. Rows without the target take no part.
    """
    known = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull())
    fitted = known.where(F.col(fold) != check)
    row = fitted.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, ACCURACY).alias(f"m{i}") for i, c in enumerate(inputs)]).first()
    medians = [row[f"m{i}"] or 0.0 for i in range(len(inputs))]
    # taken from the median, so that squares of large numbers don't drown differences
    x = [F.coalesce(F.col(c).cast("double") - m, F.lit(0.0)) for c, m in zip(inputs, medians)]
    z = known.select(F.col(fold).cast("long").alias("fold"), F.array(F.lit(1.0), *x, F.col(target).cast("double")).alias("z"))
    width = len(inputs) + 2
    g = {int(k): v.reshape(width, width) for k, v in summed(z, _products(width)).items()}
    held = g.get(check)
    rest = {k: v for k, v in g.items() if k != check}
    shape = "method string, penalty double, rmse double, r2 double, largest_weight double, chosen int"
    if held is None or not rest:
        return df.sparkSession.createDataFrame([], shape)
    n, total = held[0, 0], held[-1, -1] - held[0, -1] ** 2 / held[0, 0]
    whole, out = _Gram(sum(rest.values())), []

    def line(method: str, penalty: float | None, squares: float, largest: float | None, chosen: int) -> None:
        out.append((method, penalty, float(np.sqrt(max(squares, 0) / n)), float(1 - squares / total) if total > 0 else None, largest, chosen))

    middle = fitted_quantiles(fitted, [target], [0.5])[target][0]
    line("median", None, held[-1, -1] - 2 * middle * held[0, -1] + n * middle**2, None, 0)
    plain = whole.weights(0)
    line("least squares", 0.0, whole.squares(plain, held), float(np.abs(plain).max()), 0)
    errors = {a: 0.0 for a in penalties}
    if len(rest) > 1:
        for k, part in rest.items():
            others = _Gram(sum(v for j, v in rest.items() if j != k))
            for a in penalties:
                errors[a] += others.squares(others.weights(a), part)
    best = min(penalties, key=lambda a: (errors[a], a))
    for a in penalties:
        w = whole.weights(a)
        line("ridge", float(a), whole.squares(w, held), float(np.abs(w).max()), int(a == best))
    return df.sparkSession.createDataFrame(out, shape)
