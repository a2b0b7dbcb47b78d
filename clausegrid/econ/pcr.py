"""Principal-component regression with the number of components chosen by several criteria."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.learn.cluster import as_vector


def pc_regression(df: DataFrame, y: str, vec: str) -> DataFrame:
    """(k, aic, bic, adj_r2, loo): regression of y on a constant and the first k components, k = 0..p.

    Components come from the p x p moment matrix. They are orthogonal, so the coefficients
    of every k follow from the same sums; the leave-one-out error uses the leverage
    identity in one more pass. Rows stay in the tasks.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(vec).cast("array<double>").alias("x"))
    first = rows.agg(Summarizer.mean(as_vector("x")).alias("m"), F.avg("y").alias("ym"), F.count(F.lit(1)).alias("n")).first()
    mean, ymean, n = first["m"].toArray(), first["ym"], first["n"]
    p = len(mean)

    def gram(batches):
        for b in batches:
            x = np.stack(b["x"].to_list()) - mean
            z = np.column_stack([x, b["y"].to_numpy() - ymean])
            yield pd.DataFrame({"g": [(z.T @ z).ravel()]})

    parts = rows.mapInPandas(gram, "g array<double>")
    total = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
    g = np.array([r["v"] for r in total.collect()]).reshape(p + 1, p + 1)
    eig, axes = np.linalg.eigh(g[:p, :p])
    order = np.argsort(eig)[::-1]
    eig, axes = np.maximum(eig[order], 1e-300), axes[:, order]
    fy = axes.T @ g[:p, p]
    beta = fy / eig

    def left_out(batches):
        for b in batches:
            f = (np.stack(b["x"].to_list()) - mean) @ axes
            res = (b["y"].to_numpy() - ymean)[:, None] - np.column_stack([np.zeros(len(f)), np.cumsum(f * beta, axis=1)])
            lev = 1.0 / n + np.column_stack([np.zeros(len(f)), np.cumsum(f * f / eig, axis=1)])
            yield pd.DataFrame({"e": [((res / np.maximum(1 - lev, 1e-12)) ** 2).sum(0)]})

    loo_parts = rows.mapInPandas(left_out, "e array<double>").select(F.posexplode("e").alias("k", "v"))
    loo = {r["k"]: r["v"] for r in loo_parts.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    tss = g[p, p]
    out = []
    for k in range(p + 1):
        ssr = max(tss - float((fy[:k] ** 2 / eig[:k]).sum()), 1e-300)
        llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
        adj = 1 - (ssr / (n - k - 1)) / (tss / (n - 1)) if n > k + 1 else float("nan")
        out.append((k, float(-2 * llf + 2 * (k + 1)), float(-2 * llf + math.log(n) * (k + 1)), float(adj), float(loo[k])))
    return df.sparkSession.createDataFrame(out, "k int, aic double, bic double, adj_r2 double, loo double")


def best_k(table: DataFrame) -> DataFrame:
    """(criterion, k): the choice by each criterion."""
    return table.agg(
        F.min_by("k", "aic").alias("aic"), F.min_by("k", "bic").alias("bic"),
        F.max_by("k", "adj_r2").alias("adj_r2"), F.min_by("k", "loo").alias("loo"),
    ).unpivot([], ["aic", "bic", "adj_r2", "loo"], "criterion", "k")
