"""Reproducible samples and splits: rows are chosen by a hash of their id, never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order: the same rows for any partitioning."""
    return df.orderBy(_digest(key, seed), key).limit(n)


def unit_hash(key: str, seed: int) -> Column:
    """Number in [0, 1) that depends on the id and the seed only."""
    return F.conv(F.substring(_digest(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def train_test_split(df: DataFrame, key: str, test: float, seed: int = 0, out: str = "is_test") -> DataFrame:
    return df.withColumn(out, unit_hash(key, seed) < test)


def repeated_splits(df: DataFrame, key: str, test: float, seeds: list[int]) -> DataFrame:
    """Every row once per seed with its side of that split."""
    sides = F.array(*[F.struct(F.lit(s).alias("seed"), (unit_hash(key, s) < test).alias("is_test")) for s in seeds])
    return df.select("*", F.explode(sides).alias("_s")).select(*df.columns, "_s.seed", "_s.is_test")
