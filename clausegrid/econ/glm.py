"""Generalised linear models with several high-dimensional fixed effects."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.econ.hdfe import Effects, absorb, indexed, level_columns
from clausegrid.econ.ols import Fit, fe_ols_groups, independent, meat, sandwich, small_sample_factor, summed
from clausegrid.operators.panel import lag_panel
from clausegrid.session import materialize


def drop_empty_groups(df: DataFrame, y: str, effects: Effects) -> DataFrame:
    """Without groups whose outcome is zero throughout: their effect has no finite estimate.

    Repeats until nothing more goes, since leaving rows out may empty another group.
    """
    df = materialize(df, "live")
    n = df.count()
    while True:
        kept = df
        for effect in effects:
            live = df.groupBy(*effect).agg(F.sum(y).alias("_s")).where(F.col("_s") > 0).select(*effect)
            kept = kept.join(live, effect, "left_semi")
        df = materialize(kept, "live")
        left = df.count()
        if left == n:
            return df
        n = left


def _deviance(y: Column, mu: Column, theta: float | None) -> Column:
    own = F.when(y > 0, y * F.log(y / mu)).otherwise(0.0)
    if theta is None:
        return 2 * (own - (y - mu))
    return 2 * (own - (y + theta) * F.log((y + theta) / (mu + theta)))


@dataclass
class _Model:
    """A regression that shares its passes with others: its number names its columns."""

    number: int
    xs: list[str]
    theta: float | None = None
    last: float = math.inf
    done: bool = False
    names: list[str] | None = None
    beta: np.ndarray | None = None
    gram: np.ndarray | None = None
    deviance: float = float("nan")
    rows: int = 0

    def col(self, kind: str) -> str:
        return f"_{kind}{self.number}"

    @property
    def dims(self) -> list[str]:
        return [f"_r{self.number}_{j}" for j in range(len(self.xs))]

    @property
    def held(self) -> list[str]:
        """Columns of a finished model: its weight, mean and regressors without effects."""
        return [self.col("w"), self.col("mu"), *self.dims]


def _block_moments(df: DataFrame, blocks: list[tuple[list[str], str]]) -> list[tuple[np.ndarray, int]]:
    """Weighted products of each block (columns, weight) and the rows, all in one pass."""
    sizes = [len(cols) for cols, _ in blocks]
    wide = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for cols, w in blocks for c in [*cols, w]]

    def part(z: np.ndarray) -> np.ndarray:
        out, at = [], 0
        for p in sizes:
            x = np.column_stack([z[:, at : at + p], np.ones(len(z))])
            out.append((x.T @ (x * z[:, at + p, None])).ravel())
            at += p + 1
        return np.append(np.concatenate(out), len(z))

    total = summed(df.select(*[c.alias(f"c{i}") for i, c in enumerate(wide)]), part, sum((p + 1) ** 2 for p in sizes) + 1)
    grams, at = [], 0
    for p in sizes:
        grams.append((total[at : at + (p + 1) ** 2].reshape(p + 1, p + 1), int(total[-1])))
        at += (p + 1) ** 2
    return grams


def _irls(
    state: DataFrame, models: list[_Model], effects: Effects, base: list[str], tol: float, max_steps: int,
    inner: float = 1e-4, tables: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Weighted least squares for all models that are not done, until each one's deviance settles.

    ``state`` has ``base`` (keys, level numbers, ``_y``, the regressors), ``_eta<k>`` of open models and the held columns
    of the others. A step writes its rows once for all models, and their projections share the passes, going on from
    the estimates of the step before with a tolerance that tightens as the steps get smaller. A model that has settled
    keeps its columns and leaves the passes. Returns the rows, written, with every model's held columns, and the
    last estimates of the effects.
    """
    xs = list(dict.fromkeys(x for m in models for x in m.xs))
    spread = state.agg(*[(F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.avg(x)).alias(x) for x in xs]).first() if xs else {}
    for _ in range(max_steps):
        live = [m for m in models if not m.done]
        made = [F.col(c) for m in models if m.done for c in m.held]
        for m in live:
            mu = F.exp(m.col("eta"))
            z = F.col(m.col("eta")) + (F.col("_y") - mu) / mu
            w = mu if m.theta is None else mu / (1 + mu / m.theta)
            made += [w.alias(m.col("w")), z.alias(m.col("z")), z.alias(m.col("zt")), *[F.col(x).alias(d) for x, d in zip(m.xs, m.dims)]]
        work = materialize(state.select(*base, *made), "step")
        weights = {c: m.col("w") for m in live for c in [m.col("zt"), *m.dims]}
        if tables is not None and not {f"_a_{c}" for c in weights} <= set(tables.columns):
            tables = None
        flat, tables = absorb(work, list(weights), effects, weight=weights, tol=inner, start=tables)
        grams = _block_moments(flat, [([*m.dims, m.col("zt")], m.col("w")) for m in live])
        state, settled = flat, inner <= max(tol, 1e-9)
        for m, (gram, m.rows) in zip(live, grams):
            p = len(m.xs)
            scale = np.array([spread[x] or 0.0 for x in m.xs])
            kept = independent(gram[:p, :p], scale * gram[p + 1, p + 1] / max(m.rows, 1), 1e-10)
            m.names, m.gram = [m.xs[i] for i in kept], gram[np.ix_(kept, kept)]
            m.beta = np.linalg.solve(m.gram, gram[kept, p]) if kept else np.zeros(0)
            fitted = sum((F.lit(float(b)) * F.col(m.dims[i]) for b, i in zip(m.beta, kept)), F.lit(0.0))
            state = state.withColumn(m.col("eta"), F.col(m.col("z")) - (F.col(m.col("zt")) - fitted))
        devs = state.agg(*[F.sum(_deviance(F.col("_y"), F.exp(m.col("eta")), m.theta)).alias(m.col("dev")) for m in live]).first()
        change = 0.0
        for m in live:
            m.deviance = devs[m.col("dev")] or 0.0
            moved = abs(m.deviance - m.last) / (0.1 + abs(m.deviance))
            m.last, m.done = m.deviance, moved < tol and settled
            if m.done:
                state = state.withColumn(m.col("mu"), F.exp(m.col("eta")))
            else:
                change = max(change, moved)
        if all(m.done for m in live):
            return materialize(state.select(*base, *[c for m in models for c in m.held]), "fit"), tables
        if change < 1e-2:
            inner = max(min(inner, change * 1e-1), tol, 1e-9)
    raise RuntimeError(f"no convergence in {max_steps} steps (last change {change:.2e})")


def _digamma(x: np.ndarray | float) -> np.ndarray:
    """Asymptotic series after moving the argument up by six."""
    z = x + 6
    inv2 = 1 / (z * z)
    series = np.log(z) - 1 / (2 * z) - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 / 252))
    return series - sum(1 / (x + i) for i in range(6))


def estimate_theta(
    df: DataFrame, y: str, mu: str, lo: float = 1e-3, hi: float = 1e6, rounds: int = 4, grid: int = 40, widest: float = 1e6
) -> float:
    """Maximum-likelihood dispersion given the means: the zero of the score in theta.

    Every job evaluates the score on a whole grid; the bracket shrinks grid-fold per job. A bracket
    that does not hold the zero is moved on, up to 1 / ``widest`` and ``widest`` (beyond, the score is as
    small as its rounding errors). A score that stays positive belongs to outcomes that vary no more than
    a Poisson variable: the estimate is infinite. One that is negative from the lower end on is an error.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(mu).cast("double").alias("m"))

    def scores(at: list[float]) -> np.ndarray:
        def part(z: np.ndarray) -> np.ndarray:
            yv, m = z[:, 0], z[:, 1]
            return np.array([(_digamma(yv + t) - _digamma(t) + math.log(t) + 1 - np.log(m + t) - (yv + t) / (m + t)).sum() for t in at])

        return summed(rows, part, len(at))

    a, b, done = math.log(lo), math.log(hi), 0
    while done < rounds:
        at = [math.exp(a + (b - a) * i / grid) for i in range(grid + 1)]
        got = scores(at)
        if (got > 0).all():
            if b >= math.log(widest):
                return math.inf
            a, b = b, min(2 * b - a, math.log(widest))
            continue
        if got[0] <= 0:
            if a <= -math.log(widest):
                raise RuntimeError("the dispersion has no estimate: the score is negative throughout")
            a, b = max(2 * a - b, -math.log(widest)), a
            continue
        down = int(np.argmax(got <= 0))
        a, b, done = math.log(at[down - 1]), math.log(at[down]), done + 1
    return math.exp((a + b) / 2)


def fe_glm(
    df: DataFrame,
    y: str,
    xs: list[str],
    effects: Effects,
    family: str = "poisson",
    clusters: list[list[str]] | None = None,
    tol: float = 1e-8,
    max_steps: int = 60,
    small_sample: bool = False,
) -> Fit:
    """Poisson, Gaussian or negative binomial regression with the effects absorbed.

    Each effect is a list of key columns, e.g. [exporter, importer]. Standard errors are
    clustered by the first effect unless ``clusters`` says otherwise (one or two sets);
    ``small_sample`` multiplies the covariance by (n - 1) / (n - K). Without overdispersion the negative
    binomial's theta is infinite, and the fit is the Poisson one.
    """
    return fe_glm_groups(df, y, {"": xs}, effects, family, clusters, tol, max_steps, small_sample)[""]


def fe_glm_groups(
    df: DataFrame,
    y: str,
    groups: dict[str, list[str]],
    effects: Effects,
    family: str = "poisson",
    clusters: list[list[str]] | None = None,
    tol: float = 1e-8,
    max_steps: int = 60,
    small_sample: bool = False,
) -> dict[str, Fit]:
    """``fe_glm`` for each group of regressors, all in the same jobs: the number of written tables is that of
    the slowest regression, however many there are."""
    if family == "gaussian":
        return fe_ols_groups(df, y, groups, effects, clusters, tol, small_sample)
    if family not in ("poisson", "negbin"):
        raise ValueError(f"unknown family {family}")
    clusters = clusters or [effects[0]]
    keys = list(dict.fromkeys(k for e in effects + clusters for k in e))
    xs = list(dict.fromkeys(x for own in groups.values() for x in own))
    live = drop_empty_groups(df.select(*keys, y, *[x for x in xs if x not in keys]), y, effects)
    mean = live.agg(F.avg(y)).first()[0]
    rows = indexed(live.select(*keys, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in xs]), effects)
    base = [*keys, *level_columns(effects), "_y", *xs]
    models = [_Model(k, list(own)) for k, own in enumerate(groups.values())]
    begin = F.log((F.col("_y") + F.lit(mean)) / 2)
    state = rows.select(*base, *[begin.alias(m.col("eta")) for m in models])
    first = 1e-3 if family == "negbin" else tol
    state, tables = _irls(state, models, effects, base, first, max_steps)
    if family == "negbin":
        known: dict[int, float] = {}
        for _ in range(20):
            for m in models:
                if m.number in known and known[m.number] is None:
                    continue
                new = estimate_theta(state, "_y", m.col("mu"))
                old = known.get(m.number)
                m.done = old is not None and (new == old or abs(new - old) <= max(10 * tol, 1e-6) * old)
                known[m.number] = new
                m.theta, m.last = new if math.isfinite(new) else None, math.inf
            if all(m.done for m in models):
                break
            again = [m for m in models if not m.done]
            eta = [F.log(m.col("mu")).alias(m.col("eta")) for m in again]
            state = state.select(*base, *[c for m in models if m.done for c in m.held], *eta)
            state, tables = _irls(state, models, effects, base, tol, max_steps, max(tol, 1e-9), tables)
            for m in again:
                m.done = False
        else:
            raise RuntimeError("the dispersion did not settle in 20 rounds")
    else:
        known = {}
    scored = {}
    for m in models:
        score = F.col(m.col("w")) * (F.col("_y") - F.col(m.col("mu"))) / F.col(m.col("mu"))
        scored |= {f"_s{m.number}_{x}": F.col(m.dims[m.xs.index(x)]) * score for x in m.names}
    rows = state.select(*keys, *[v.alias(n) for n, v in scored.items()])
    filling = meat(rows, list(scored), F.lit(1.0), clusters) if scored else np.zeros((0, 0))
    out, at = {}, 0
    for name, m in zip(groups, models):
        p = len(m.names)
        bread = np.linalg.inv(m.gram) if p else np.zeros((0, 0))
        cov = sandwich(bread, filling[at : at + p, at : at + p]) if p else bread
        at += p
        if small_sample:
            cov = cov * small_sample_factor(state, m.rows, p, effects, clusters)
        out[name] = Fit(m.names, m.beta, cov, m.rows, [x for x in m.xs if x not in m.names], m.deviance, known.get(m.number, float("nan")))
    return out


def sub_regressions(
    df: DataFrame, y: str, groups: dict[str, list[str]], effects: Effects, family: str = "poisson",
    clusters: list[list[str]] | None = None, tol: float = 1e-8,
) -> DataFrame:
    """One regression per column group (e.g. the columns of a chapter), in shared jobs; tidy rows stacked."""
    fits = fe_glm_groups(df, y, groups, effects, family, clusters, tol)
    return reduce(DataFrame.unionByName, [fit.tidy(df.sparkSession, name) for name, fit in fits.items()])


def lagged_regression(
    df: DataFrame, y: str, xs: list[str], k: int, unit: list[str], time: str, effects: Effects,
    family: str = "poisson", clusters: list[list[str]] | None = None, tol: float = 1e-8,
) -> Fit:
    """Regression on the regressors of k years earlier; rows without that year are left out."""
    lagged = lag_panel(df, unit, time, xs, k)
    names = [f"{x}_lag{k}" for x in xs]
    full = materialize(lagged.na.drop(subset=names), "lagged")
    return fe_glm(full, y, names, effects, family, clusters, tol)
