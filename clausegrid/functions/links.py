"""Link rules over stored pages: which links to follow and what to call the documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extract_links(
    pages: DataFrame,
    key: str,
    html: str,
    keep: Sequence[str],
    drop: Sequence[str],
    cut: Sequence[str],
) -> DataFrame:
    """(key, link, name): links matching every ``keep`` and no ``drop`` rule, named by what remains after ``cut``."""
    found = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    for rule in keep:
        found = found.where(F.col("link").rlike(rule))
    for rule in drop:
        found = found.where(~F.col("link").rlike(rule))
    name = reduce(lambda acc, p: F.regexp_replace(acc, f"(?i){p}", ""), cut, F.col("link"))
    return found.select(key, "link", name.alias("name"))
