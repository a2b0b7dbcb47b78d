"""Allow and block rules on urls: a trie over reversed host labels, then path segments.

The rules are one small list of checked size; the trie goes to every worker as a broadcast. Rows are
judged where they are, without a shuffle, so frequent hosts cost nothing extra.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules beyond this number are refused: the trie must fit every worker.
MAX_RULES = 1_000_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + 1, F.length(rest))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Rules (host, path, verdict) as nested dictionaries.

    A host node has labels under ``h`` and, under ``p``, the trie of the paths of rules that end there.
    A path node has its segments under ``s``, unfinished last segments under ``t``, and a verdict under ``v``.
    Equal rules with different verdicts are refused.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("h", {}).setdefault(label, {})
        node = node.setdefault("p", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault("s", {}).setdefault(segment, {})
        if last:
            node = node.setdefault("t", {}).setdefault(last, {})
        if node.setdefault("v", (host + path, verdict)) != (host + path, verdict):
            raise ValueError(f"two verdicts for {host}{path}")
    return root


def longest(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The deepest host with a fitting path wins; under one host the longest path."""
    best, node = (None, None), trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get("h", {}).get(label)
        if node is None:
            break
        found, at = None, node.get("p")
        for k, segment in enumerate(segments):
            if at is None:
                break
            found = at.get("v", found)
            ends = [t for t in at.get("t", ()) if segment.startswith(t)]
            if ends:
                found = at["t"][max(ends, key=len)]["v"]
            at = at.get("s", {}).get(segment) if k + 1 < len(segments) else None
        best = found or best
    return best


def judge(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict; without a fitting rule the verdict is ``default`` and the rule null.
    Input columns of these names are replaced."""
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        found = [longest(trie.value, h, p) for h, p in zip(host, path)]
        return pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}, dtype=object)

    host, path = split_url(F.col(url))
    out = df.select(*kept, host.alias("host"), path.alias("path")).withColumn("_found", look("host", "path"))
    return out.select(*kept, "host", "path", "_found.rule", "_found.verdict")
