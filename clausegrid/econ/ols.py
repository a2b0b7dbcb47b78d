"""Least squares from distributed moment sums; only p x p matrices reach the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.econ.hdfe import Effects, residualize
from clausegrid.session import materialize


def summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of what ``part`` makes of every batch of rows (a matrix of doubles, a column each).

    A task adds its batches up and hands on one array of ``size`` numbers; the arrays are added by position.
    """

    def task(batches):
        total = np.zeros(size)
        for b in batches:
            total += part(b.to_numpy(dtype=float))
        yield pd.DataFrame({"v": [total]})

    sums = df.mapInPandas(task, "v array<double>").select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in sums.collect():
        out[r["i"]] = r["v"]
    return out


def moments(df: DataFrame, cols: list[Column | str], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """Matrix of the sums of products of the columns (null counts as 0), and the number of rows. One pass."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    p = len(cs)
    wide = [c.cast("double") for c in cs] + [F.lit(1.0) if weight is None else weight.cast("double")]

    def part(z: np.ndarray) -> np.ndarray:
        x = z[:, :p]
        return np.append((x.T @ (x * z[:, p:])).ravel(), len(z))

    total = summed(df.select(*[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(wide)]), part, p * p + 1)
    return total[:-1].reshape(p, p), int(total[-1])


def independent(gram: np.ndarray, scale: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns kept when absorbed and collinear ones are left out, first come first kept.

    ``scale`` holds the columns' sums of squares before the effects went out.
    """
    kept: list[int] = []
    for j in range(len(gram)):
        if gram[j, j] <= tol * max(scale[j], 1e-300):
            continue
        if kept:
            a, b = gram[np.ix_(kept, kept)], gram[kept, j]
            rest = gram[j, j] - b @ np.linalg.solve(a, b)
            if rest <= tol * max(gram[j, j], 1e-300):
                continue
        kept.append(j)
    return kept


def meat(df: DataFrame, xs: list[str], score: Column, clusters: list[list[str]]) -> np.ndarray:
    """Outer products of cluster score sums; two cluster sets are combined by inclusion and exclusion."""

    def one(keys: list[str]) -> tuple[np.ndarray, int]:
        sums = df.groupBy(*keys).agg(*[F.sum(F.col(x) * score).alias(x) for x in xs])
        return moments(sums, list(xs))

    if len(clusters) > 2:
        raise ValueError("at most two cluster sets")
    parts = [one(c) for c in clusters]
    total = sum(m * (g / (g - 1) if g > 1 else 1.0) for m, g in parts)
    if len(clusters) == 2:
        m, g = one(list(dict.fromkeys(clusters[0] + clusters[1])))
        total = total - m * (g / (g - 1) if g > 1 else 1.0)
    return total


def sandwich(bread: np.ndarray, filling: np.ndarray) -> np.ndarray:
    """Covariance of the estimates. Two-way sums may leave a negative variance; negative
    eigenvalues are then set to zero, as the sum of the true covariances has none."""
    cov = bread @ filling @ bread
    if len(cov) and np.diag(cov).min() < 0:
        values, axes = np.linalg.eigh((cov + cov.T) / 2)
        cov = (axes * np.maximum(values, 0.0)) @ axes.T
    return cov


def small_sample_factor(df: DataFrame, n: int, p: int, effects: Effects, clusters: list[list[str]]) -> float:
    """(n - 1) / (n - K): K counts the p regressors and the levels of the effects, one level of each further
    effect being implied. An effect that is nested in a cluster (has all its keys) is not counted."""
    open_ = [e for e in effects if not any(set(c) <= set(e) for c in clusters)]
    levels = sum(df.select(*e).distinct().count() for e in open_)
    k = p + max(levels - max(len(open_) - 1, 0), 1)
    if n <= k:
        raise ValueError(f"{n} rows are too few for {k} parameters")
    return (n - 1) / (n - k)


@dataclass
class Fit:
    terms: list[str]
    estimate: np.ndarray
    covariance: np.ndarray
    rows: int
    dropped: list[str]
    deviance: float = float("nan")
    theta: float = float("nan")

    def tidy(self, spark: SparkSession, model: str = "") -> DataFrame:
        """(model, term, estimate, std_error, statistic, p_value)."""
        out = []
        for i, t in enumerate(self.terms):
            b, v = float(self.estimate[i]), float(self.covariance[i, i])
            se = math.sqrt(v) if v > 0 else float("nan")
            stat = b / se if se == se and se > 0 else float("nan")
            out.append((model, t, b, se, stat, math.erfc(abs(stat) / math.sqrt(2)) if stat == stat else float("nan")))
        return spark.createDataFrame(
            out, "model string, term string, estimate double, std_error double, statistic double, p_value double"
        )


def fe_ols(
    df: DataFrame,
    y: str,
    xs: list[str],
    effects: Effects,
    clusters: list[list[str]] | None = None,
    tol: float = 1e-8,
    small_sample: bool = False,
) -> Fit:
    """OLS of y on xs with the effects absorbed; absorbed and collinear columns are dropped.

    Standard errors are clustered (by the first effect unless told otherwise), one or two ways;
    ``small_sample`` multiplies the covariance by (n - 1) / (n - K).
    """
    return fe_ols_groups(df, y, {"": xs}, effects, clusters, tol, small_sample)[""]


def fe_ols_groups(
    df: DataFrame,
    y: str,
    groups: dict[str, list[str]],
    effects: Effects,
    clusters: list[list[str]] | None = None,
    tol: float = 1e-8,
    small_sample: bool = False,
) -> dict[str, Fit]:
    """``fe_ols`` for each group of regressors: the effects are taken out of all columns once, and one matrix of
    their products serves every regression."""
    clusters = clusters or [effects[0]]
    keys = list(dict.fromkeys(k for e in effects + clusters for k in e))
    xs = list(dict.fromkeys(x for own in groups.values() for x in own))
    base = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in [y, *xs]])
    before = base.agg(*[(F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.avg(x)).alias(x) for x in xs]).first() if xs else {}
    flat = materialize(residualize(base, [y, *xs], effects, tol=tol), "flat")
    gram, n = moments(flat, [*xs, y])
    p = len(xs)
    fits, scored = {}, {}
    for k, (name, own) in enumerate(groups.items()):
        at = [xs.index(x) for x in own]
        kept = [at[i] for i in independent(gram[np.ix_(at, at)], np.array([before[x] or 0.0 for x in own]))]
        names = [xs[i] for i in kept]
        bread = np.linalg.inv(gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
        beta = bread @ gram[kept, p]
        error = F.col(y) - sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, names)), F.lit(0.0))
        scored |= {f"_s{k}_{x}": F.col(x) * error for x in names}
        ssr = gram[p, p] - float(beta @ gram[kept, p]) if kept else gram[p, p]
        fits[name] = Fit(names, beta, bread, n, [x for x in own if x not in names], deviance=ssr)
    rows = flat.select(*keys, *[v.alias(c) for c, v in scored.items()])
    filling, at = meat(rows, list(scored), F.lit(1.0), clusters) if scored else np.zeros((0, 0)), 0
    for fit in fits.values():
        size = len(fit.terms)
        if size:
            fit.covariance = sandwich(fit.covariance, filling[at : at + size, at : at + size])
        if small_sample:
            fit.covariance = fit.covariance * small_sample_factor(flat, n, size, effects, clusters)
        at += size
    return fits


def rank_check(df: DataFrame, cols: list[str], tol: float = 1e-9) -> tuple[int, list[str]]:
    """Rank of the design, and the columns that depend on the ones before them."""
    gram, _ = moments(df, cols)
    kept = independent(gram, np.diag(gram), tol)
    return len(kept), [c for i, c in enumerate(cols) if i not in kept]
