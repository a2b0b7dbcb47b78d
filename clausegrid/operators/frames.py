"""Small projections, filters and set operations on frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match a pattern, in schema order."""
    return [c for c in df.columns if re.search(pattern, c)]


def cast_numeric(df: DataFrame, to: str, keep: list[str]) -> DataFrame:
    """Cast every numeric column but those in ``keep``."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)} - set(keep)
    return df.select([F.col(c).cast(to).alias(c) if c in numeric else F.col(c) for c in df.columns])


def min_words(col: str | Column, more_than: int) -> Column:
    """True where the text has more than the given number of words."""
    return F.size(F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " ")) > more_than


def compound_key(*cols: str | Column, sep: str = "_") -> Column:
    """Joined key; null as soon as one part is null."""
    parts: list = []
    for c in cols:
        parts += [F.lit(sep), c] if parts else [c]
    return F.concat(*parts)


def fill_across(cols: list[str]) -> list[Column]:
    """Each column, or the nearest non-null column to its left."""
    return [F.coalesce(*[F.col(c) for c in reversed(cols[: i + 1])]).alias(cols[i]) for i in range(len(cols))]


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Blank strings become null in every string column."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        [F.when(~F.col(c).rlike(r"^\s*$"), F.col(c)).alias(c) if c in text else F.col(c) for c in df.columns]
    )


def stack(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def outer_merge(frames: list[DataFrame]) -> DataFrame:
    """Natural full outer join over the columns that neighbours share."""
    return reduce(lambda a, b: a.join(b, [c for c in a.columns if c in b.columns], "full_outer"), frames)


def map_rows(df: DataFrame, col: str, sep: str = r",\s*") -> DataFrame:
    """One row per entry of a separated list cell."""
    return df.withColumn(col, F.explode(F.split(col, sep)))


def override(col: str | Column, cases: dict[str, str], by: str | Column) -> Column:
    """Literal replacement for named rows, the old value elsewhere."""
    by = F.col(by) if isinstance(by, str) else by
    hit = reduce(lambda acc, kv: acc.when(by == kv[0], F.lit(kv[1])), cases.items(), F)
    return hit.otherwise(F.col(col) if isinstance(col, str) else col)
