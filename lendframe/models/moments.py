"""Closed-form models: each is one distributed aggregate and a small solve on the driver.

The aggregates are d x d at most (d = number of model inputs), never a row of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions.stable import sigmoid
from lendframe.models.arrays import dot, matrix


def _partials(df: DataFrame, cols: Sequence[str], extra: Sequence[str], size: int, kernel) -> np.ndarray:
    """Sum over all rows of ``kernel(X, extra...)``, a flat array of ``size`` numbers.

    Every partition returns one row. The rows are added on executors by position, so the driver
    receives ``size`` numbers whatever the number of partitions.
    """
    names, more = list(cols), list(extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            total += kernel(b[names].to_numpy(float), *[b[e].to_numpy(float) for e in more])
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    rows = (df.select(*[F.col(c).cast("double").alias(c) for c in [*names, *more]])
            .mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


# ---------------------------------------------------------------- logistic regression by Newton steps
def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _curvature(df: DataFrame, cols: Sequence[str], y: str, at: np.ndarray, ridge: np.ndarray
               ) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised loss, slope and bend at one point, all from a single pass."""
    k = len(at)

    def kernel(x, t):
        x = _with_one(x)
        z = x @ at
        log_one = np.logaddexp(0.0, z)  # -ln P(0); P(1) = exp(z - log_one) never overflows
        p = np.exp(z - log_one)
        return np.concatenate([[np.sum(log_one - t * z)], (p - t) @ x, np.einsum("ni,n,nj->ij", x, p - p * p, x).ravel()])

    flat = _partials(df, cols, [y], 1 + k + k * k, kernel)
    return (flat[0] + 0.5 * float(ridge @ at**2), flat[1 : 1 + k] + ridge * at,
            flat[1 + k :].reshape(k, k) + np.diag(ridge))


def fit_newton_logistic(df: DataFrame, cols: Sequence[str], y: str, C: float = 1.0, max_iter: int = 100,
                        tol: float = 1e-8) -> dict:
    """L2 logistic regression: coefficients, intercept, Hessian at them, and the number of steps.

    A point is judged and the next step prepared by the same pass. A point that is worse than the
    best so far is drawn half way back to it, until it is no worse or the step has vanished.
    """
    ridge = np.array([1.0 / C] * len(cols) + [0.0])
    best = np.zeros(len(ridge))
    loss, slope, bend = _curvature(df, cols, y, best, ridge)
    steps = 0
    for steps in range(1, max_iter + 1):
        reach = -np.linalg.solve(bend, slope)
        found = _curvature(df, cols, y, best + reach, ridge)
        while found[0] > loss and np.abs(reach).max() > 1e-10:
            reach = reach / 2
            found = _curvature(df, cols, y, best + reach, ridge)
        if found[0] <= loss:
            best, (loss, slope, bend) = best + reach, found
        if found[0] > loss or np.abs(reach).max() < tol:
            break
    return {"cols": list(cols), "coef": best[:-1].tolist(), "intercept": float(best[-1]),
            "hessian": bend.tolist(), "steps": steps, "loss": float(loss)}


def linear_logit(model: dict) -> Column:
    """Log-odds of a fitted linear model as a plain expression."""
    return dot(model["cols"], model["coef"]) + F.lit(model["intercept"])


def newton_probability(model: dict) -> Column:
    return sigmoid(linear_logit(model))


def laplace_columns(model: dict) -> dict[str, Column]:
    """Bayesian logistic regression: logit deviation from the inverse Hessian, corrected probability."""
    s = np.linalg.inv(np.array(model["hessian"]))
    xs = [F.col(c).cast("double") for c in model["cols"]] + [F.lit(1.0)]
    variance = F.lit(0.0)
    for i, row in enumerate(s):
        inner = F.lit(0.0)
        for x, v in zip(xs, row):
            inner = inner + x * float(v)
        variance = variance + xs[i] * inner
    logit = linear_logit(model)
    return {"logit": logit, "logit_std": F.sqrt(variance),
            "p": sigmoid(logit / F.sqrt(1 + F.lit(np.pi / 8) * variance))}


# ---------------------------------------------------------------- Gaussian naive Bayes
def fit_naive_bayes(df: DataFrame, cols: Sequence[str], y: str, var_smoothing: float = 1e-9) -> dict:
    """Class shares, means and population variances; one aggregate."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}")]
    overall = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    eps = var_smoothing * max(overall[f"v{i}"] for i in range(len(cols)))
    rows = df.where(F.col(y).isNotNull()).groupBy(y).agg(*aggs).collect()
    total = sum(r["n"] for r in rows)
    return {"cols": list(cols), "classes": {
        int(r[y]): {"prior": r["n"] / total, "mean": [r[f"m{i}"] for i in range(len(cols))],
                    "var": [r[f"v{i}"] + eps for i in range(len(cols))]} for r in rows}}


def naive_bayes_logit(model: dict) -> Column:
    """ln P(1 | x) - ln P(0 | x)."""
    def joint(k: int) -> Column:
        c = model["classes"][k]
        out = F.lit(float(np.log(c["prior"]) - 0.5 * np.sum(np.log(2 * np.pi * np.array(c["var"])))))
        for name, m, v in zip(model["cols"], c["mean"], c["var"]):
            out = out - F.pow(F.col(name).cast("double") - m, 2) / (2 * v)
        return out
    return joint(1) - joint(0)


# ---------------------------------------------------------------- LDA and PCA
def _centre(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Column means; second moments are taken around them, as raw squares lose all digits far from 0."""
    sums = _partials(df, cols, [], 1 + len(cols), lambda x: np.concatenate([[len(x)], x.sum(axis=0)]))
    return sums[1:] / max(sums[0], 1)


def _class_moments(df: DataFrame, cols: Sequence[str], y: str, classes: Sequence[int]):
    d, k = len(cols), len(classes)
    labels, middle = np.array(list(classes), dtype=float), _centre(df, cols)

    def kernel(x, t):
        x = x - middle
        parts = [(x.T @ x).ravel()]
        for c in labels:
            inside = x[t == c]
            parts.append(np.concatenate([[len(inside)], inside.sum(axis=0)]))
        return np.concatenate(parts)
    sums = _partials(df, cols, [y], d * d + k * (d + 1), kernel)
    second = sums[:d * d].reshape(d, d)
    rest = sums[d * d:].reshape(k, d + 1)
    return second, rest[:, 0], rest[:, 1:] / rest[:, :1], middle


def fit_lda(df: DataFrame, cols: Sequence[str], y: str, n_components: int | None = None,
            reg: float = 1e-10) -> dict:
    """Fisher projection and the shared-covariance classifier from class means and scatter."""
    classes = sorted(r[0] for r in df.select(y).distinct().collect())
    second, n, means, middle = _class_moments(df, cols, y, classes)  # means around the middle
    total, d = n.sum(), len(cols)
    within = second - (means.T * n) @ means
    within = (within + within.T) / 2 / total
    within += reg * np.trace(within) / d * np.eye(d)
    centre = (n[:, None] * means).sum(axis=0) / total
    between = ((means - centre).T * n) @ (means - centre) / total
    root = np.linalg.cholesky(within)
    half = np.linalg.solve(root, np.linalg.solve(root, between).T)
    values, vectors = np.linalg.eigh((half + half.T) / 2)
    keep = np.argsort(values)[::-1][: n_components or min(len(classes) - 1, d)]
    axes = np.linalg.solve(root.T, vectors[:, keep])
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    weights = means @ np.linalg.inv(within)
    bias = np.log(n / total) - 0.5 * np.sum(weights * means, axis=1) - weights @ middle
    return {"cols": list(cols), "classes": [int(c) for c in classes], "centre": (centre + middle).tolist(),
            "axes": axes.T.tolist(), "weights": weights.tolist(), "bias": bias.tolist()}


def lda_columns(model: dict) -> dict[str, Column]:
    """Projected coordinates lda1.. (centred)."""
    cols, centre = model["cols"], np.array(model["centre"])
    return {f"lda{i + 1}": dot(cols, axis) - F.lit(float(np.dot(axis, centre)))
            for i, axis in enumerate(model["axes"])}


def lda_class(model: dict) -> Column:
    """Most likely class."""
    scores = matrix(model["cols"], model["weights"], model["bias"])
    pairs = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("c"))
                      for i, (s, c) in enumerate(zip(scores, model["classes"]))])
    return F.array_max(pairs)["c"]


def fit_pca(df: DataFrame, cols: Sequence[str], n_components: int | None = None) -> dict:
    """Principal axes (largest entry positive), variances and their shares."""
    d = len(cols)

    middle = _centre(df, cols)

    def kernel(x):
        x = x - middle
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
    sums = _partials(df, cols, [], 1 + d + d * d, kernel)
    n, rest = sums[0], sums[1:d + 1] / sums[0]  # what rounding left of the mean
    mean = middle + rest
    cov = (sums[d + 1:].reshape(d, d) - n * np.outer(rest, rest)) / (n - 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1]
    values, axes = np.maximum(values[order], 0), vectors[:, order].T
    axes *= np.sign(axes[range(d), np.abs(axes).argmax(axis=1)])[:, None]
    k = n_components or d
    return {"cols": list(cols), "mean": mean.tolist(), "axes": axes[:k].tolist(), "variance": values[:k].tolist(),
            "share": (values / values.sum())[:k].tolist()}


def pca_columns(model: dict) -> dict[str, Column]:
    mean = np.array(model["mean"])
    return {f"pc{i + 1}": dot(model["cols"], axis) - F.lit(float(np.dot(axis, mean)))
            for i, axis in enumerate(model["axes"])}


def components_for(model: dict, share: float = 0.9) -> int:
    """First component at which the cumulative share reaches ``share``."""
    return int(np.searchsorted(np.cumsum(model["share"]), share - 1e-12) + 1)
