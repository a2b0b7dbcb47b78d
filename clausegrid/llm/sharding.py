"""Sharding by a hierarchical weighted hash tree.

A topology names the shards of racks of regions, each shard with a weight; a rack or region weighs what its shards
weigh. A row descends from the root: at each level every child draws -ln(u) / weight, u being a hash of the
row's key and the child's name, and the least draw wins. Each draw depends on one child alone, so when a weight
changes, rows move only into subtrees that gained and out of subtrees that lost. A new shard in a region of
its own therefore takes rows only into itself, wherever they were.

The descent is made of column functions over literal arrays; nothing is shuffled to place a row. Slots number
the rows of a shard in key order by ranges, so that a shard is never one task.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.scan import position
from clausegrid.session import materialize

#: (region, rack, shard, weight) of every shard.
Topology = list[tuple[str, str, int, float]]

#: Shards that a topology may have: its nodes are literals of the plan.
MOST_SHARDS = 10_000
#: Shards of a rack and racks of a region in ``grid``.
RACK_SHARDS, REGION_RACKS = 2, 2


def grid(shards: int, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS) -> Topology:
    """Equal shards 0 to n - 1, dealt over racks and regions in order."""
    per_region = rack_shards * region_racks
    return [(f"region{s // per_region}", f"rack{s // rack_shards}", s, 1.0) for s in range(shards)]


def with_shard(topology: Topology, shard: int, weight: float = 1.0) -> Topology:
    """One more shard in a region of its own: rows move into it and nowhere else."""
    if any(s == shard for _, _, s, _ in topology):
        raise ValueError(f"shard {shard} is there already")
    name = f"shard{shard}"
    return [*topology, (f"own-{name}", f"own-{name}", shard, weight)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """Exponential draw of rate ``weight`` from 52 bits of a digest of child and key."""
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit("|"), key).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / weight


def _winner(key: Column, children: Column) -> Column:
    """Name of the child with the least draw; equal draws go to the first name."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _children(pairs: Iterable[tuple[str, float]]) -> Column:
    total: dict[str, float] = defaultdict(float)
    for name, weight in pairs:
        total[name] += weight
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in sorted(total.items())])


def _checked(topology: Topology) -> Topology:
    shards = [s for _, _, s, _ in topology]
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("a topology has at least one shard, and each shard once")
    if len(shards) > MOST_SHARDS:
        raise ValueError(f"{len(shards)} shards; the descent holds at most {MOST_SHARDS}")
    if any(not (w >= 0 and math.isfinite(w)) for *_, w in topology):
        raise ValueError("weights are finite and not negative")
    alive = [t for t in topology if t[3] > 0]
    if not alive:
        raise ValueError("no shard has a weight")
    return alive


def place(df: DataFrame, key: Column, topology: Topology, out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row. A null key has one place of its own, as any other value; rows with equal
    keys share a shard. Shards of weight zero take nothing."""
    alive = _checked(topology)
    name = F.coalesce(F.concat(F.lit("+"), key.cast("string")), F.lit("-"))
    racks, shards = defaultdict(list), defaultdict(list)
    for region, rack, shard, weight in alive:
        racks[region].append((f"{region}/{rack}", weight))
        shards[f"{region}/{rack}"].append((f"{region}/{rack}/{shard}", weight))
    by_region = F.create_map(*[x for r in sorted(racks) for x in (F.lit(r), _children(racks[r]))])
    by_rack = F.create_map(*[x for r in sorted(shards) for x in (F.lit(r), _children(shards[r]))])
    spare = [f"_{out}_{k}" for k in ("key", "region", "rack")]
    df = df.withColumn(spare[0], name)
    df = df.withColumn(spare[1], _winner(F.col(spare[0]), _children((r, w) for r, _, _, w in alive)))
    df = df.withColumn(spare[2], _winner(F.col(spare[0]), by_region[F.col(spare[1])]))
    last = F.substring_index(_winner(F.col(spare[0]), by_rack[F.col(spare[2])]), "/", -1)
    return df.withColumn(out, last.cast("int")).drop(*spare)


def assign(docs: DataFrame, topology: Topology, grown: Topology | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size (UTF-8 bytes of the text and one more), text_crc32, shard, grown_shard, slot (from 0 in each shard,
    in the order of key, size, crc). A null text has no bytes; repeated rows have a slot each."""
    raw = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).alias("_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = place(rows, F.col("_id"), topology)
    rows = place(rows, F.col("_id"), grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = materialize(rows.withColumn("_order", F.struct("_id", "size", "text_crc32")), "placed")
    rows = position(rows, ["shard"], "_order", "slot")
    return rows.select(F.col("_id").alias(key), "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, topology: Topology, path: str, key: str = "doc_id", rows_per_file: int = 100_000) -> None:
    """Writes the rows as folders shard=0, shard=1, ... of Parquet files; a shard is spread over as many tasks as it
    fills files, so no shard is one task. Other columns go along; a column named shard is replaced."""
    placed = place(docs.drop("shard"), F.col(key), topology)
    n = max(docs.count(), 1)
    weight = {s: w for _, _, s, w in _checked(topology)}
    total = sum(weight.values())
    parts = F.create_map(*[x for s, w in weight.items() for x in (F.lit(s), F.lit(max(1, math.ceil(n * w / total / rows_per_file))))])
    salted = placed.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if c != "shard"]), parts[F.col("shard")]))
    files = sum(max(1, math.ceil(n * w / total / rows_per_file)) for w in weight.values())
    salted.repartition(files, "shard", "_salt").drop("_salt").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
