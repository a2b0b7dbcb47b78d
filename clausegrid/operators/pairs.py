"""Training pairs for similarity models.

The number of pairs stays linear in the rows: each row meets its own label's anchor
(target 0.9) and the anchor of every other label (target 0.1), instead of
every row meeting every other. The anchor is the row with the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.labels import bounded_values

# Target similarity of pairs with the same and with different labels.
SAME, DIFFERENT = 0.9, 0.1


def _anchors(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.min(key).alias("anchor"))


def contrastive_pairs(df: DataFrame, key: str, label: str, max_labels: int = 1000) -> DataFrame:
    """(a, b, target): every row with all anchors but itself; labels are few and checked."""
    labels = bounded_values(df, label, max_labels)
    rows = df.where(F.col(label).isNotNull()).select(F.col(key).alias("a"), F.col(label).alias("own"))
    wide = rows.select("a", "own", F.explode(F.array(*[F.lit(x) for x in labels])).alias(label))
    met = wide.join(_anchors(df, key, label), label).where(F.col("a") != F.col("anchor"))
    target = F.when(F.col("own") == F.col(label), SAME).otherwise(DIFFERENT)
    return met.select("a", F.col("anchor").alias("b"), target.alias("target"))


def contrastive_pairs_light(df: DataFrame, key: str, label: str, max_labels: int = 1000) -> DataFrame:
    """(a, b, target): every row with its own anchor, and the anchors with one another."""
    bounded_values(df, label, max_labels)
    anchors = _anchors(df.where(F.col(label).isNotNull()), key, label)
    same = df.join(anchors, label).where(F.col(key) != F.col("anchor"))
    same = same.select(F.col(key).alias("a"), F.col("anchor").alias("b"), F.lit(SAME).alias("target"))
    ring = anchors.agg(F.array_sort(F.collect_list("anchor")).alias("s")).select(
        F.explode(
            F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x AS a, y AS b))))")
        ).alias("p")
    )
    return same.unionByName(ring.select("p.a", "p.b", F.lit(DIFFERENT).alias("target")))
