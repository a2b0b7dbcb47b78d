"""Document fingerprints from column functions only: one-permutation MinHash, densified and packed.

Each run of five words is hashed once. The top seven bits choose one of 128 bins, the smallest hash of a bin
stays. An empty bin takes the value of the first full bin in its probe order: six fixed probes, then all bins
by a fixed ranking, so every non-empty text fills all bins. The low byte of each bin is stored as two hex
digits; likeness corrects the share of equal bytes for bytes that are equal by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.scan import global_index
from clausegrid.session import materialize

BINS, SHINGLE_WORDS, PROBES = 128, 5, 6
CHANCE = 1 / 256


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 57)


def _literal(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def _probes() -> list[list[int]]:
    """For each probe the bin that every bin looks at, drawn once and for all."""
    draw = random.Random(7)
    return [[draw.randrange(BINS) for _ in range(BINS)] for _ in range(PROBES)]


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column: 256 hex digits, empty for null, empty and blank texts.

    Words are parted by blanks, tabs and line breaks and compared in lower case; fewer than five words are one
    shingle. The steps are columns of their own, as a step used inside a lambda would be worked out anew for
    every element. An input column of the same name is replaced.
    """
    made = [f"_{out}_{k}" for k in ("words", "sorted", "firsts", "bins", "full", "all")]
    words, ranked, firsts, bins, full, every = (F.col(c) for c in made)
    hashed = F.transform(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), ""), lambda w: F.xxhash64(w))
    run = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE_WORDS), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE_WORDS))))
    shingles = F.when(F.size(words) >= SHINGLE_WORDS, run).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.expr("cast(array() as array<bigint>)"))
    number = F.sequence(F.lit(0), F.lit(BINS - 1))

    def ranking(b: Column) -> Column:
        order = F.transform(firsts, lambda v: F.struct(F.xxhash64(b, _bin(v)).alias("r"), v.alias("v")))
        return F.array_min(order)["v"]

    def borrowed(b: Column) -> Column:
        return F.coalesce(F.get(full, b), *(F.get(full, F.get(_literal(p), b)) for p in _probes()), ranking(b))

    df = df.withColumn(made[0], hashed).withColumn(made[1], F.sort_array(shingles))
    df = df.withColumn(made[2], F.filter(ranked, lambda v, i: (i == 0) | (_bin(F.get(ranked, i - 1)) != _bin(v)))).drop(made[0], made[1])
    df = df.withColumn(made[3], F.transform(firsts, _bin))
    df = df.withColumn(made[4], F.transform(number, lambda b: F.get(firsts, (F.array_position(bins, b) - 1).cast("int")))).drop(made[3])
    filled = F.when(F.size(firsts) == BINS, full).otherwise(F.transform(number, borrowed))
    df = df.withColumn(made[5], F.when(F.size(firsts) > 0, filled)).drop(made[2], made[4])
    digits = F.array_join(F.transform(every, lambda v: F.lpad(F.hex(v.bitwiseAND(255)), 2, "0")), "")
    return df.withColumn(out, F.coalesce(digits, F.lit(""))).drop(made[5])


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles from two fingerprints, 0 to 1; two empty ones are alike, one is not."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substr(a, 2 * i + 1, F.lit(2)) == F.substr(b, 2 * i + 1, F.lit(2))))
    share = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - CHANCE) / (1 - CHANCE))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(share)


def next_rows(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """For each row of (key, tie, n), all different, the row behind it in descending order of the key: columns
    key, tie, n and next_key, next_tie; behind the last comes the first. Null keys come last."""
    placed = materialize(global_index(rows, [F.col(key).desc_nulls_last(), F.col(tie)], "pos"), "placed")
    total = placed.count()
    behind = placed.select(F.pmod(F.col("pos") - 1 + total, F.lit(max(total, 1))).alias("pos"), F.col(key).alias("next_key"), F.col(tie).alias("next_tie"))
    return placed.join(behind, "pos").drop("pos")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has its last third replaced by the start of the next document in descending key order.
    Null texts are empty. Rows that repeat key and text are one document here and all get its result; equal
    keys with different texts follow one another by the texts' hash.
    """
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    prints = fingerprint(base, "text", "fingerprint").select("key", "tie", F.length("text").cast("long").alias("n"), "fingerprint")
    prints = materialize(prints, "prints")
    known = prints.groupBy("key", "tie").agg(F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"))
    pairs = materialize(next_rows(known.select("key", "tie", "n"), "key", "tie"), "pairs")

    def on(left: DataFrame, right: DataFrame, k: str, t: str, how: str = "inner") -> DataFrame:
        right = right.withColumnsRenamed({k: "_k", t: "_t"})
        return left.join(right, left["key"].eqNullSafe(right["_k"]) & (left["tie"] == right["_t"]), how).drop("_k", "_t")

    asked = pairs.select("next_key", "next_tie", F.col("key").alias("for_key"), F.col("tie").alias("for_tie"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    given = on(base, asked, "next_key", "next_tie").select("for_key", "for_tie", "need", F.substr("text", F.lit(1), F.col("need")).alias("start"))
    given = given.groupBy("for_key", "for_tie").agg(F.first("need").alias("need"), F.first("start").alias("start"))
    edited = on(base, given, "for_key", "for_tie")
    kept = F.substr("text", F.lit(1), F.length("text") - F.col("need"))
    edited = edited.select("key", "tie", F.length("text").cast("long").alias("n_chars"), F.concat(kept, F.col("start")).alias("edited"))
    edited = fingerprint(edited, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    follower = on(pairs.select(F.col("next_key").alias("key"), F.col("next_tie").alias("tie"), F.col("key").alias("of_key"), F.col("tie").alias("of_tie")), known, "key", "tie")
    follower = follower.select("of_key", "of_tie", F.col("fingerprint").alias("next_fingerprint"))
    out = on(on(edited, known.select("key", "tie", "fingerprint"), "key", "tie"), follower, "of_key", "of_tie")
    return out.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
