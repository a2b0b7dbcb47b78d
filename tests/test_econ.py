import math

import numpy as np
import pytest

from clausegrid.econ import glm, hdfe, ols, pcr

EFFECTS = [["unit"], ["year"]]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(8):
        for t in range(7):
            if (u, t) in {(0, 0), (3, 4)}:
                continue
            x1, x2 = float(rng.normal()), float(rng.normal() + 0.3 * u)
            mu = np.exp(1.0 + 0.4 * x1 - 0.2 * x2 + 0.1 * u + 0.05 * t)
            rows.append((u, t, x1, x2, float(rng.poisson(mu * rng.gamma(4, 0.25)))))
    return rows, spark.createDataFrame(rows, "unit int, year int, x1 double, x2 double, y double")


def dummies(rows):
    u = np.array([r[0] for r in rows])
    t = np.array([r[1] for r in rows])
    d = [(u == v).astype(float) for v in sorted(set(u))] + [(t == v).astype(float) for v in sorted(set(t))[1:]]
    return np.column_stack([[r[2] for r in rows], [r[3] for r in rows], *d]), np.array([r[4] for r in rows])


def test_residuals_have_no_group_means(frame):
    _, df = frame
    flat = hdfe.residualize(df, ["x1", "y"], EFFECTS, tol=1e-10)
    assert hdfe.group_mean_gap(flat, ["x1", "y"], EFFECTS) < 1e-6


def test_ols_equals_dummy_regression(frame):
    rows, df = frame
    x, y = dummies(rows)
    want = np.linalg.lstsq(x, y, rcond=None)[0][:2]
    fit = ols.fe_ols(df, "y", ["x1", "x2"], EFFECTS, tol=1e-10)
    assert np.allclose(fit.estimate, want, atol=1e-6)


def test_clustered_errors_match_direct_formula(frame):
    rows, df = frame
    x, y = dummies(rows)
    proj = x[:, 2:]
    flat = x[:, :2] - proj @ np.linalg.lstsq(proj, x[:, :2], rcond=None)[0]
    resid = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    bread = np.linalg.inv(flat.T @ flat)
    unit = np.array([r[0] for r in rows])
    s = np.array([(flat[unit == g] * resid[unit == g, None]).sum(0) for g in sorted(set(unit))])
    want = bread @ (s.T @ s) @ bread * 8 / 7
    fit = ols.fe_ols(df, "y", ["x1", "x2"], EFFECTS, tol=1e-10)
    assert np.allclose(fit.covariance, want, rtol=1e-5)


def test_absorbed_and_collinear_columns_go(frame):
    from pyspark.sql import functions as F

    _, df = frame
    more = df.withColumn("level", F.col("unit") * 1.5).withColumn("twice", 2 * F.col("x1"))
    fit = ols.fe_ols(more, "y", ["x1", "level", "twice", "x2"], EFFECTS)
    assert fit.terms == ["x1", "x2"] and fit.dropped == ["level", "twice"]
    assert ols.rank_check(more, ["x1", "twice", "x2"]) == (2, ["twice"])


def irls(x, y, theta=None):
    b = np.zeros(x.shape[1])
    eta = np.log((y + y.mean()) / 2)
    for _ in range(200):
        mu = np.exp(eta)
        w = mu if theta is None else mu / (1 + mu / theta)
        z = eta + (y - mu) / mu
        s = np.sqrt(w)
        b = np.linalg.lstsq(x * s[:, None], z * s, rcond=None)[0]
        eta = x @ b
    return b, np.exp(eta)


def test_poisson_equals_dummy_regression(frame):
    rows, df = frame
    x, y = dummies(rows)
    want, mu = irls(x, y)
    fit = glm.fe_glm(df, "y", ["x1", "x2"], EFFECTS, "poisson")
    assert np.allclose(fit.estimate, want[:2], atol=1e-5)
    dev = 2 * np.sum(np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0) - (y - mu))
    assert abs(fit.deviance - dev) < 1e-4


def test_negbin_scores_vanish(frame):
    rows, df = frame
    fit = glm.fe_glm(df, "y", ["x1"], [["unit"]], "negbin")
    x = np.column_stack([[r[2] for r in rows], *[[float(r[0] == u) for r in rows] for u in range(8)]])
    y = np.array([r[4] for r in rows])
    want, _ = irls(x, y, fit.theta)
    assert fit.theta > 0 and abs(fit.estimate[0] - want[0]) < 1e-4


def test_empty_groups_leave(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (2, 1, 3.0), (2, 2, 1.0)], "a int, b int, y double")
    assert {r.a for r in glm.drop_empty_groups(df, "y", [["a"], ["b"]]).collect()} == {2}


def test_component_regression_matches_direct_fits(spark):
    n, p = 47, 5
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, p)).cumsum(axis=1) * np.linspace(2.0, 0.5, p)
    y = 1.5 + 0.7 * x[:, 0] - 0.4 * x[:, 3] + rng.uniform(-1, 1, size=n)
    df = spark.createDataFrame([(float(a), [float(v) for v in b]) for a, b in zip(y, x)], "y double, x array<double>")
    got = {r.k: r for r in pcr.pc_regression(df, "y", "x").collect()}
    xc = x - x.mean(0)
    _, _, vt = np.linalg.svd(xc, full_matrices=False)
    for k in range(p + 1):
        d = np.column_stack([np.ones(n), xc @ vt.T[:, :k]])
        loo = 0.0
        for i in range(n):
            keep = np.arange(n) != i
            b = np.linalg.lstsq(d[keep], y[keep], rcond=None)[0]
            loo += (y[i] - d[i] @ b) ** 2
        b = np.linalg.lstsq(d, y, rcond=None)[0]
        ssr = ((y - d @ b) ** 2).sum()
        aic = n * (np.log(2 * np.pi) + np.log(ssr / n) + 1) + 2 * (k + 1)
        assert abs(got[k].loo - loo) < 1e-6 and abs(got[k].aic - aic) < 1e-6


def test_dispersion_bracket_moves_or_raises(spark):
    rng = np.random.default_rng(5)
    mu = rng.uniform(2, 9, size=4000)
    for theta in (2e-4, 3.0):
        y = rng.poisson(mu * rng.gamma(theta, 1 / theta, size=len(mu))).astype(float)
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, mu)], "y double, mu double")
        assert 0.5 * theta < glm.estimate_theta(df, "y", "mu") < 2 * theta
    even = spark.createDataFrame([(4.0, 4.0)] * 20, "y double, mu double")
    assert glm.estimate_theta(even, "y", "mu") == math.inf
    none = spark.createDataFrame([(0.0, 4.0)] * 20, "y double, mu double")
    with pytest.raises(RuntimeError, match="negative"):
        glm.estimate_theta(none, "y", "mu")


def test_wide_moments_and_rank(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 300))
    x[:, 299] = x[:, 0] + x[:, 1]
    cols = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in cols))
    gram, n = ols.moments(df, cols)
    assert n == 400 and np.allclose(gram, x.T @ x)
    assert ols.rank_check(df, cols) == (299, ["c299"])


def test_small_sample_factor_counts_open_effects(spark):
    df = spark.createDataFrame([(i % 5, i % 4, float(i * i % 17), float(i % 3)) for i in range(60)], "a int, b int, y double, x double")
    plain = ols.fe_ols(df, "y", ["x"], [["a"], ["b"]])
    scaled = ols.fe_ols(df, "y", ["x"], [["a"], ["b"]], small_sample=True)
    assert np.allclose(scaled.covariance, plain.covariance * 59 / (60 - 1 - 4))  # a is the cluster, b has four levels


def chained(n):
    """Two effects that meet in a chain only: level k of one meets levels k and k + 1 of the other."""
    rng = np.random.default_rng(9)
    return [(k, k + step, float(rng.normal()), float(rng.normal())) for k in range(n) for step in (0, 1)]


@pytest.mark.parametrize("fetched", [0, 4_000_000])
def test_badly_connected_effects_settle_in_few_passes(spark, monkeypatch, fetched):
    monkeypatch.setattr(hdfe, "MOST_FETCHED", fetched)
    rows = chained(16)
    df = spark.createDataFrame(rows, "a int, b int, x double, y double")
    history: list[float] = []
    flat, _ = hdfe.absorb(df, ["x", "y"], [["a"], ["b"]], tol=1e-8, history=history)
    d = np.zeros((32, 33))
    for i, r in enumerate(rows):
        d[i, r[0]] = d[i, 16 + r[1]] = 1
    v = np.array([r[2:] for r in rows])
    want = v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    got = np.array([tuple(r) for r in flat.orderBy("a", "b").select("x", "y").collect()])
    assert np.allclose(got, want, atol=1e-6)
    turns, rest = 0, v.copy()
    while turns < 2000:  # subtracting means in turn
        for at in (0, 1):
            keys = [r[at] for r in rows]
            means = {k: rest[[q == k for q in keys]].mean(axis=0) for k in set(keys)}
            rest = rest - np.array([means[k] for k in keys])
        turns += 1
        if np.abs(rest - want).max() < 1e-6:
            break
    assert 2 * (len(history) - 1) <= turns


@pytest.fixture(scope="module")
def trade(spark):
    rng = np.random.default_rng(12)
    rows = []
    for e in range(6):
        for i in range(6):
            for t in range(5):
                if e == i or rng.random() < 0.15:
                    continue
                a, b, c = (float(v) for v in rng.normal(size=3))
                mu = np.exp(2 + 0.3 * a - 0.2 * b + 0.1 * c + 0.1 * e - 0.05 * i + 0.1 * rng.normal())
                rows.append((e, i, t, a, b, c, float(rng.poisson(mu * rng.gamma(3, 1 / 3))) + 0.5))
    return rows, spark.createDataFrame(rows, "e int, i int, t int, a double, b double, c double, y double")


GRAVITY = [["e", "i"], ["e", "t"], ["i", "t"]]


def gravity_dummies(rows, at):
    sets = [sorted({(r[p], r[q]) for r in rows}) for p, q in ((0, 1), (0, 2), (1, 2))]
    d = [[float((r[p], r[q]) == v) for r in rows] for (p, q), own in zip(((0, 1), (0, 2), (1, 2)), sets) for v in own]
    return np.column_stack([[r[k] for r in rows] for k in at] + d), np.array([r[6] for r in rows])


def test_chapter_regressions_share_their_jobs(trade, monkeypatch):
    rows, df = trade
    groups = {"one": ["a", "b"], "two": ["c"], "three": ["a", "c"]}
    written = []
    kept = {m: m.materialize for m in (hdfe, glm)}
    for m in kept:
        monkeypatch.setattr(m, "materialize", lambda d, label="stage", m=m: written.append(label) or kept[m](d, label))
    fits = glm.fe_glm_groups(df, "y", groups, GRAVITY, "poisson", tol=1e-7)
    together = len(written)
    for name, xs in groups.items():
        want, _ = irls(*gravity_dummies(rows, [3 + "abc".index(x) for x in xs]))
        assert np.allclose(fits[name].estimate, want[: len(xs)], atol=1e-5)
    written.clear()
    single = glm.fe_glm(df, "y", ["a", "b"], GRAVITY, "poisson", tol=1e-7)
    assert np.allclose(fits["one"].estimate, single.estimate, atol=1e-6) and np.allclose(fits["one"].covariance, single.covariance, rtol=1e-4)
    assert together <= len(written) + 2


def test_negbin_and_lags_with_pair_effects(trade):
    rows, df = trade
    fit = glm.fe_glm(df, "y", ["a"], GRAVITY, "negbin", tol=1e-6)
    want, _ = irls(*gravity_dummies(rows, [3]), fit.theta)
    assert abs(fit.estimate[0] - want[0]) < 1e-4
    lagged = glm.lagged_regression(df, "y", ["a"], 1, ["e", "i"], "t", GRAVITY, tol=1e-7)
    before = {r[:3]: r for r in rows}
    late = [(*r[:3], before[(r[0], r[1], r[2] - 1)][3], *r[4:]) for r in rows if (r[0], r[1], r[2] - 1) in before]
    want, _ = irls(*gravity_dummies(late, [3]))
    assert np.allclose(lagged.estimate, want[:1], atol=1e-5)


def test_block_least_squares(trade):
    _, df = trade
    groups = {"one": ["a", "b"], "two": ["c"]}
    fits = ols.fe_ols_groups(df, "y", groups, GRAVITY)
    for name, xs in groups.items():
        single = ols.fe_ols(df, "y", xs, GRAVITY)
        assert fits[name].terms == xs and np.allclose(fits[name].estimate, single.estimate) and np.allclose(fits[name].covariance, single.covariance)
