"""Repeated random splits scored by one classifier each, all splits fitted in the same passes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.econ.ols import summed
from clausegrid.operators.sampling import unit_hash
from clausegrid.session import materialize


def split_table(df: DataFrame, key: str, vec: str, label: str, dims: int, test: float, seeds: list[int]) -> DataFrame:
    """Flat rows: ``dims`` features, label 0 or 1, and per seed 1 where the row is held out. Written once."""
    known = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    cols = [F.col(vec)[d].cast("double").alias(f"x{d}") for d in range(dims)] + [F.col(label).cast("double").alias("y")]
    return materialize(known.select(*cols, *[(unit_hash(key, s) < test).cast("double").alias(f"h{i}") for i, s in enumerate(seeds)]), "splits")


def fit_splits(
    table: DataFrame, dims: int, splits: int, ridge: float = 1.0, tol: float = 1e-8, rounds: int = 100
) -> np.ndarray:
    """Coefficients (a row a split, the intercept last) of ridge logistic regressions, one on each split's training side.

    Newton steps for all splits at once: a pass hands on, for every split, its loss, gradient and curvature, so the
    number of jobs does not grow with the splits. Each task adds up splits * (dims + 1) * (dims + 4) / 2 numbers or so. A step
    that makes a split's loss worse is halved for this split. The ridge takes in the intercept, so each split has one
    solution, also with a single class or without rows (zeros). An error if a split has not settled after ``rounds``.
    """
    p = dims + 1
    i, j = np.triu_indices(p)
    beta, good, best = np.zeros((splits, p)), np.zeros((splits, p)), np.full(splits, np.inf)

    for _ in range(rounds):
        at = beta

        def part(z: np.ndarray) -> np.ndarray:
            loss, slope, curve = np.zeros(splits), np.zeros((splits, p)), np.zeros((splits, len(i)))
            for k in range(0, len(z), 512):
                rows = z[k : k + 512]
                x, y, train = np.hstack([rows[:, :dims], np.ones((len(rows), 1))]), rows[:, dims : dims + 1], 1 - rows[:, dims + 1 :]
                eta = x @ at.T
                mu = 0.5 * (1 + np.tanh(0.5 * eta))
                loss += (train * (np.logaddexp(0, eta) - y * eta)).sum(0)
                slope += (train * (mu - y)).T @ x
                curve += (train * mu * (1 - mu)).T @ (x[:, i] * x[:, j])
            return np.concatenate([loss, slope.ravel(), curve.ravel()])

        total = summed(table, part, splits * (1 + p + len(i)))
        loss = total[:splits] + 0.5 * ridge * (beta**2).sum(1)
        slope = total[splits : splits * (1 + p)].reshape(splits, p) + ridge * beta
        curve = total[splits * (1 + p) :].reshape(splits, len(i))
        change = 0.0
        following = beta.copy()
        for s in range(splits):
            if loss[s] > best[s] + 1e-9 * (1 + abs(best[s])):
                following[s] = 0.5 * (beta[s] + good[s])
                change = np.inf
                continue
            bend = np.zeros((p, p))
            bend[i, j] = bend[j, i] = curve[s]
            step = np.linalg.solve(bend + ridge * np.eye(p), slope[s])
            good[s], best[s], following[s] = beta[s], loss[s], beta[s] - step
            change = max(change, np.abs(step).max())
        beta = following
        if change < tol:
            return beta
    raise RuntimeError(f"not all splits have settled after {rounds} rounds")


def scored_splits(
    df: DataFrame, key: str, vec: str, label: str, dims: int, test: float = 0.2, seeds: int = 100, ridge: float = 1.0
) -> DataFrame:
    """(seed, n_train, n_test, hits, accuracy, mean_accuracy) for each of the seeds 0, 1, ...

    Every seed splits the rows by a hash of their id, fits a logistic regression on the training side and
    counts the held-out rows that it gets right (a score of exactly one half says 0). Rows without a vector or label are left out; a
    seed without held-out rows has no accuracy and does not count in the mean. Repeated ids fall on the same side.
    """
    table = split_table(df, key, vec, label, dims, test, list(range(seeds)))
    beta = fit_splits(table, dims, seeds, ridge)

    def part(z: np.ndarray) -> np.ndarray:
        x, y, held = np.hstack([z[:, :dims], np.ones((len(z), 1))]), z[:, dims : dims + 1], z[:, dims + 1 :]
        right = ((x @ beta.T > 0) == (y > 0.5)) * held
        return np.concatenate([(1 - held).sum(0), held.sum(0), right.sum(0)])

    train, held, hits = summed(table, part, 3 * seeds).reshape(3, seeds)
    share = [float(h / n) if n else None for h, n in zip(hits, held)]
    known = [a for a in share if a is not None]
    mean = float(np.mean(known)) if known else None
    rows = [(s, int(train[s]), int(held[s]), int(hits[s]), share[s], mean) for s in range(seeds)]
    return df.sparkSession.createDataFrame(rows, "seed int, n_train long, n_test long, hits long, accuracy double, mean_accuracy double")
