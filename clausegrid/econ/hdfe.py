"""Fixed effects removed by conjugate gradients, as DataFrame jobs.

The rows are written once and never rewritten; each row carries a number for its level of every effect. The
levels of all effects are one table, which holds estimates, what is left of their sums, and the direction of the
next step. A pass joins the directions to the rows and sums them per level again, so it writes one table, and its length
is chosen from sums over that table. On badly connected levels this takes about the square root of the passes that
subtracting group means in turn takes. Any number of columns, each with weights of its own, go through the same passes.

Where the pairs of levels that meet in a row are few (their number is checked), their summed weights are all that the
passes need: they are fetched once, and the same passes run on them in the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.session import materialize

Effects = list[list[str]]

#: Numbers (pairs of levels, two ids and a weight for each kind of weight) that the driver takes at most.
MOST_FETCHED = 4_000_000
#: A step that leaves less than this share of the rest is measured again, as differences of sums are too coarse.
SHARP = 1e-8


def demean(df: DataFrame, cols: list[str], effect: list[str], weight: str | None = None) -> DataFrame:
    """Subtract the group means of one effect."""
    table = _means(df, {c: F.col(c) for c in cols}, effect, weight, "_m_")
    joined = df.join(table, effect)
    return joined.select([(F.col(c) - F.col(f"_m_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns])


def _means(df: DataFrame, values: dict[str, Column], effect: list[str], weight: str | None, prefix: str) -> DataFrame:
    if weight:
        aggs = [(F.sum(F.col(weight) * v) / F.sum(weight)).alias(f"{prefix}{c}") for c, v in values.items()]
    else:
        aggs = [F.avg(v).alias(f"{prefix}{c}") for c, v in values.items()]
    return df.groupBy(*effect).agg(*aggs)


def _largest(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def level_columns(effects: Effects) -> list[str]:
    return [f"_l{f}" for f in range(len(effects))]


def indexed(df: DataFrame, effects: Effects) -> DataFrame:
    """Rows, written down, with a number for the level of each effect (``_l0``, ``_l1``, ...). Rows with a null key go."""
    df = df.na.drop(subset=list(dict.fromkeys(k for e in effects for k in e)))
    names = [f"_n{f}" for f in range(len(effects))]
    df = df.select("*", *[F.concat(F.lit(f"{f}:"), F.to_json(F.struct(*e))).alias(n) for f, (e, n) in enumerate(zip(effects, names))])
    levels = df.select(F.explode(F.array(*names)).alias("_name")).distinct()
    levels = materialize(levels.select("_name", F.monotonically_increasing_id().alias("_level")), "levels")
    for name, level in zip(names, level_columns(effects)):
        df = df.join(levels.select(F.col("_name").alias(name), F.col("_level").alias(level)), name).drop(name)
    return materialize(df, "panel")


def absorb(
    df: DataFrame,
    cols: list[str],
    effects: Effects,
    weight: str | dict[str, str] | None = None,
    tol: float = 1e-8,
    max_passes: int = 500,
    start: DataFrame | None = None,
    history: list[float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows with the effects taken out of ``cols``, table of estimates per level).

    ``df`` should be written, with level numbers from ``indexed`` (else they are made here); ``weight`` is one column for
    all or one for each of ``cols``. Stops when the group means that are left, each weighted with its rows, are less
    than ``tol`` times the column's spread; running out of passes is an error. ``start`` continues from an
    earlier table of estimates for these levels. ``history`` is given the largest rest after each pass.
    """
    ids = level_columns(effects)
    if not set(ids) <= set(df.columns):
        df = indexed(df, effects)
    named = weight if isinstance(weight, dict) else {c: weight for c in cols}
    kinds = list(dict.fromkeys(named[c] for c in cols))
    total = {c: F.col(f"_g{kinds.index(named[c])}") for c in cols}
    by = {c: F.lit(1.0) if named[c] is None else F.col(named[c]) for c in cols}

    def met(table: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, Column]]:
        """Rows, and for each column the sum of its table entries over the levels of the row."""
        rows = df
        for level in ids:
            rows = rows.join(table.select(F.col("_level").alias(level), *[F.col(f"{prefix}{c}").alias(f"{level}_{c}") for c in cols]), level)
        return rows, {c: reduce(lambda a, b: a + b, [F.col(f"{level}_{c}") for level in ids]) for c in cols}

    def summed(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        """Sums per level of every effect."""
        split = rows.select(F.explode(F.array(*ids)).alias("_level"), *[v.alias(n) for n, v in values.items()])
        return split.groupBy("_level").agg(*[F.sum(n).alias(n) for n in values])

    def read(table: DataFrame, values: dict[str, Column]) -> dict[str, float]:
        got = table.agg(*[F.sum(v).alias(n) for n, v in values.items()]).first()
        return {n: got[n] or 0.0 for n in values}

    moments = {}
    for c in cols:
        moments |= {f"{c} w": by[c], f"{c} x": by[c] * F.col(c), f"{c} xx": by[c] * F.col(c) * F.col(c)}
    at = read(df, moments)
    spread = {}
    for c in cols:
        whole, mean = at[f"{c} xx"], at[f"{c} x"] ** 2 / at[f"{c} w"] if at[f"{c} w"] else 0.0
        spread[c] = whole - mean if whole - mean > 1e-14 * whole else whole
    fetched = _fetched(df, ids, [F.lit(1.0) if w is None else F.col(w) for w in kinds])
    if fetched is not None:
        sums = summed(df, {f"_r_{c}": by[c] * F.col(c) for c in cols})
        table = _solved(fetched, sums, cols, [kinds.index(named[c]) for c in cols], spread, tol, max_passes, history)
        rows, known = met(table, "_a_")
        return rows.select([(F.col(c) - known[c]).alias(c) if c in known else F.col(c) for c in df.columns]), table
    left = {c: F.col(f"_r_{c}") * F.col(f"_r_{c}") / total[c] for c in cols}
    rows, known = met(start, "_a_") if start is not None else (df, {c: F.lit(0.0) for c in cols})
    values = {f"_r_{c}": by[c] * (F.col(c) - known[c]) for c in cols}
    state = summed(rows, values | {f"_g{k}": F.lit(1.0) if w is None else F.col(w) for k, w in enumerate(kinds)})
    if start is not None:
        state = state.join(start.select("_level", *[f"_a_{c}" for c in cols]), "_level")
    else:
        state = state.select("*", *[F.lit(0.0).alias(f"_a_{c}") for c in cols])
    state = materialize(state.select("*", *[(F.col(f"_r_{c}") / total[c]).alias(f"_d_{c}") for c in cols]), "effects")
    rest = read(state, left)
    keep = ["_level", *[f"_g{k}" for k in range(len(kinds))]]
    for _ in range(max_passes + 1):
        worst = max((rest[c] / spread[c] if spread[c] > 0 else 0.0) for c in cols) ** 0.5
        if history is not None:
            history.append(worst)
        if worst <= tol:
            rows, known = met(state, "_a_")
            flat = rows.select([(F.col(c) - known[c]).alias(c) if c in known else F.col(c) for c in df.columns])
            return flat, state.select("_level", *[f"_a_{c}" for c in cols])
        rows, along = met(state, "_d_")
        state = materialize(state.join(summed(rows, {f"_q_{c}": by[c] * along[c] for c in cols}), "_level"), "effects")
        wanted = {}
        for c in cols:
            d, q, r = (F.col(f"_{k}_{c}") for k in "dqr")
            wanted |= {f"{c} dq": d * q, f"{c} rr": r * r / total[c], f"{c} rq": r * q / total[c], f"{c} qq": q * q / total[c]}
        at = read(state, wanted)
        open_ = {c: rest[c] > tol * tol * spread[c] and at[f"{c} dq"] > 0 for c in cols}
        step = {c: at[f"{c} rr"] / at[f"{c} dq"] if open_[c] else 0.0 for c in cols}
        after = {c: at[f"{c} rr"] - 2 * step[c] * at[f"{c} rq"] + step[c] ** 2 * at[f"{c} qq"] for c in cols}
        new = {c: F.col(f"_r_{c}") - F.lit(step[c]) * F.col(f"_q_{c}") for c in cols}
        if any(open_[c] and after[c] <= SHARP * at[f"{c} rr"] for c in cols):
            after = read(state, {c: new[c] * new[c] / total[c] for c in cols})
        turn = {c: after[c] / at[f"{c} rr"] if open_[c] and at[f"{c} rr"] > 0 else 0.0 for c in cols}
        state = state.select(
            *keep, *[new[c].alias(f"_r_{c}") for c in cols],
            *[(F.col(f"_a_{c}") + F.lit(step[c]) * F.col(f"_d_{c}")).alias(f"_a_{c}") for c in cols],
            *[(new[c] / total[c] + F.lit(turn[c]) * F.col(f"_d_{c}")).alias(f"_d_{c}") for c in cols],
        )
        rest = {c: after[c] for c in cols}
    raise RuntimeError(f"fixed effects did not settle in {max_passes} passes (rest {worst:.2e})")


def _fetched(df: DataFrame, ids: list[str], weights: list[Column]) -> pd.DataFrame | None:
    """Columns i, j and the summed weights of all pairs of levels that share a row, a level with itself among them;
    None if that is more than ``MOST_FETCHED`` numbers."""
    pairs = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for k, a in enumerate(ids) for b in ids[k:]])
    names = [f"_g{k}" for k in range(len(weights))]
    met = df.select(F.explode(pairs).alias("p"), *[w.alias(n) for w, n in zip(weights, names)])
    met = met.groupBy("p").agg(*[F.sum(n).alias(n) for n in names]).select("p.i", "p.j", *names)
    most = MOST_FETCHED // (2 + len(weights))
    got = met.limit(most + 1).toPandas()
    return None if len(got) > most else got


def _solved(pairs: pd.DataFrame, sums: DataFrame, cols: list[str], kind: list[int], spread: dict[str, float], tol: float, max_passes: int, history: list[float] | None) -> DataFrame:
    """Table of estimates per level from fetched pairs and the columns' sums per level; passes as in ``absorb``."""
    own = pairs[pairs["i"] == pairs["j"]].sort_values("i")
    levels = own["i"].to_numpy()
    n = len(levels)
    i, j = np.searchsorted(levels, pairs["i"]), np.searchsorted(levels, pairs["j"])
    apart = i != j
    i, j = i[apart], j[apart]
    weights = [pairs[f"_g{k}"].to_numpy(float)[apart] for k in range(max(kind) + 1)]
    totals = [own[f"_g{k}"].to_numpy(float) for k in range(max(kind) + 1)]
    rhs = sums.toPandas().sort_values("_level")
    table = {"_level": levels}
    for c, k in zip(cols, kind):
        w, total = weights[k], totals[k]
        r, a = rhs[f"_r_{c}"].to_numpy(float), np.zeros(n)
        z = r / total
        d, rest = z, float(r @ z)
        limit, passes = (tol / 100) ** 2 * spread[c], 0
        while rest > limit:
            if passes == max(max_passes, 4 * n):
                if rest > tol**2 * spread[c]:
                    raise RuntimeError(f"fixed effects did not settle in {passes} passes")
                break
            q = total * d + np.bincount(i, w * d[j], n) + np.bincount(j, w * d[i], n)
            step = rest / float(d @ q)
            a, r = a + step * d, r - step * q
            z = r / total
            before, rest = rest, float(r @ z)
            d = z + rest / before * d
            passes += 1
            if history is not None and len(history) < passes:
                history.append((rest / spread[c]) ** 0.5)
        table[f"_a_{c}"] = a
    return sums.sparkSession.createDataFrame(pd.DataFrame(table))


def residualize(
    df: DataFrame,
    cols: list[str],
    effects: Effects,
    weight: str | None = None,
    tol: float = 1e-8,
    max_passes: int = 500,
) -> DataFrame:
    """``df`` with the effects taken out of ``cols``; rows with a null key go. A single effect needs one pass."""
    typed = df.select([F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    if len(effects) == 1:
        return demean(typed, cols, effects[0], weight)
    return absorb(indexed(typed, effects), cols, effects, weight, tol, max_passes)[0].select(*df.columns)


def group_mean_gap(df: DataFrame, cols: list[str], effects: Effects) -> float:
    """Largest absolute group mean left in ``cols`` over all effects."""
    gaps = []
    for effect in effects:
        means = df.groupBy(*effect).agg(*[F.avg(c).alias(c) for c in cols])
        gaps.append(means.agg(F.max(_largest([F.abs(c) for c in cols]))).first()[0] or 0.0)
    return reduce(max, gaps, 0.0)
