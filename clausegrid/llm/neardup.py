"""Near duplicates by one-permutation MinHash with optimal densification and star-shaped candidate edges.

One hash per shingle: its top bits choose the bin, each bin keeps its smallest hash, and an empty bin borrows
from the first full bin in a probe order of its own, the same for all documents. As many bins make a band key
as leave a pair at the threshold without a common band at most once in a million pairs (five at 0.85, four at 0.8).

Equal shingle sets are one node from the start. In each band bucket the member that shares most buckets with
others is the centre, and only centre-to-member edges are made, so a bucket of n sets gives n - 1 edges. An
edge counts once the full shingle sets confirm it. Then all members of a bucket that are not yet in one component are
compared set by set, in blocks of bounded size, the centre among them, so that each pair with a common band is in one
component or ruled out by its full sets. Sketches only spare the centres' edges texts that are not likely to link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.arrays import SHINGLE_WORDS, mix, shingle_sets
from clausegrid.operators.sieve import sifted
from clausegrid.session import materialize, passing_tables

BINS, BAND_ROWS = 128, 5
_BIN_BITS = 7
#: A pair at the threshold may share no band with this chance at most.
LEAST_MISS = 1e-6
#: Pairs of sets with this many shingles each are estimated first; smaller ones go to the exact check at once.
ESTIMATE_FROM = 256
#: How far an estimate may lie under the threshold: six standard deviations of the match count at 0.85.
ESTIMATE_SLACK = 0.2
#: Bounds of a block of sets that is compared with another one in a task: sets, and shingles in all.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 17
_SLICE = 4096
#: Doublings of the steps of a round towards the smallest node.
JUMPS = 3


def band_rows(percent: int) -> int:
    """Bins of a band key, at most ``BAND_ROWS``."""
    fits = [r for r in range(1, BAND_ROWS + 1) if (1 - (percent / 100) ** r) ** (BINS // r) <= LEAST_MISS]
    return max(fits, default=1)


def probe_ranks() -> np.ndarray:
    """For each bin the place of every other bin in its probe order: independent, fixed permutations."""
    order = np.random.default_rng(20).random((BINS, BINS)).argsort(axis=1)
    return order.argsort(axis=1)


def signature(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin of a sorted set that is not empty, with empty bins filled."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - _BIN_BITS)
    at = np.append(np.searchsorted(hashes, edges), len(hashes))
    full = at[:-1] < at[1:]
    out = hashes[np.minimum(at[:-1], len(hashes) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        givers = np.flatnonzero(full)
        out[empty] = out[givers[ranks[np.ix_(empty, givers)].argmin(axis=1)]]
    return out


def band_keys(values: np.ndarray, per_band: int = BAND_ROWS) -> np.ndarray:
    bands = BINS // per_band
    parts = mix(values[: bands * per_band]).reshape(bands, per_band)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(per_band):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def set_name(hashes: np.ndarray) -> bytes:
    """Sixteen bytes that name a shingle set: two independent sums over its mixed hashes."""
    a = mix(hashes + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(hashes ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return np.array([a, b]).tobytes()


def sketches(docs: DataFrame, key: str, text: str, count: int = SHINGLE_WORDS, per_band: int = BAND_ROWS) -> DataFrame:
    """key, n_shingles, sid (name of the set), bands, low (one byte a bin); the last three null for an empty set."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        ranks = probe_ranks()
        for batch in batches:
            sizes, names, bands, low = [], [], [], []
            for hashes in shingle_sets(batch.column(1), count):
                sizes.append(len(hashes))
                if not len(hashes):
                    names.append(None), bands.append(None), low.append(None)
                    continue
                values = signature(hashes, ranks)
                names.append(set_name(hashes))
                bands.append(band_keys(values, per_band))
                low.append((mix(values) & np.uint64(255)).astype(np.uint8).tobytes())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "sid", "bands", "low"])

    return rows.mapInArrow(run, f"id {kind}, n_shingles long, sid binary, bands array<long>, low binary")


def _likely(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose sizes allow the threshold and whose sketches do not rule it out, with an estimate."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("low").alias("low_a"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("low").alias("low_b"))
    both = edges.join(one, "a").join(two, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    least = percent / 100 - ESTIMATE_SLACK

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("low_a", "low_b"))
            match = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            small = np.minimum(batch.column(batch.schema.get_field_index("n_a")), batch.column(batch.schema.get_field_index("n_b"))) < ESTIMATE_FROM
            keep = pa.array(small | (match >= least))
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("a")), batch.column(batch.schema.get_field_index("b")), pa.array(match)], ["a", "b", "likeness"])
            yield out.filter(keep)

    return both.select("a", "b", "n_a", "n_b", "low_a", "low_b").mapInArrow(run, "a binary, b binary, likeness double")


def _confirmed(edges: DataFrame, texts: DataFrame, percent: int, count: int) -> DataFrame:
    """Edges whose full shingle sets meet the threshold."""
    one = texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))
    both = edges.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            first = [k for k, n in enumerate(names) if k == 0 or n != names[k - 1]]
            centres = dict(zip((names[k] for k in first), shingle_sets(batch.column(2).take(pa.array(first, pa.int64())), count)))
            keep = []
            for name, own in zip(names, shingle_sets(batch.column(3), count)):
                other = centres[name]
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the smallest node that can be reached.

    Each round every node goes to its smallest neighbour, or stays if it is smaller, and on along such steps; links
    between the places reached are what the next round works on, so the graph shrinks until none are left.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "ways")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        steps = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "steps")
        for _ in range(JUMPS):
            steps = steps.join(steps.select(F.col("node").alias("label"), F.col("label").alias("_on")), "label").select("node", F.col("_on").alias("label"))
        steps = materialize(steps, "steps")
        labels = steps if labels is None else _labelled(labels.withColumnRenamed("label", "_at"), steps, "_at", "label").select("node", "label")
        ends = _labelled(_labelled(edges, steps, "a", "_a"), steps, "b", "_b").filter("_a <> _b")
        edges = materialize(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "ways")
    return materialize(labels, "labels")


def _labelled(df: DataFrame, labels: DataFrame | None, node: str, out: str) -> DataFrame:
    if labels is None:
        return df.withColumn(out, F.col(node))
    known = labels.select(F.col("node").alias(node), F.col("label").alias("_l"))
    return df.join(known, node, "left").withColumn(out, F.coalesce("_l", node)).drop("_l")


def set_components(sets: DataFrame, rows: DataFrame, percent: int, count: int = SHINGLE_WORDS) -> DataFrame | None:
    """(node, label) of linked sets; None without any link.

    sets: sid, rep (a row's id), n, bands, low; rows: id, text of all documents.
    """
    members = sets.select("sid", F.explode("bands").alias("h"))
    sizes = members.groupBy("h").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialize(members.join(sizes, "h"), "shared")
    if shared.isEmpty():
        return None
    shared = materialize(shared.join(shared.groupBy("sid").agg(F.sum("size").alias("pop")), "sid").select("h", "sid", "pop"), "buckets")
    wanted = sets.join(shared.select("sid").distinct(), "sid", "left_semi").select("sid", F.col("rep").alias("id"))
    wanted = materialize(wanted, "wanted")
    maybe, _ = sifted(rows, "id", wanted.select("id"))
    texts = materialize(_named(maybe.join(wanted, "id"), count), "texts")
    centres = shared.groupBy("h").agg(F.max(F.struct("pop", "sid")).alias("c")).select("h", F.col("c.sid").alias("a"))
    edges = shared.join(centres, "h").filter("sid <> a").select("a", F.col("sid").alias("b")).distinct()
    likely = materialize(_likely(edges, sets, percent), "likely").select("a", "b")
    found = materialize(_confirmed(likely, texts, percent, count), "links")
    labels = None if found.isEmpty() else components(found)
    left = _labelled(shared, labels, "sid", "label").select("h", "sid", "label")
    found = materialize(_rest(left, sets, texts, percent, count), "links")
    if found.isEmpty():
        return labels
    ends = _labelled(_labelled(found, labels, "a", "_a"), labels, "b", "_b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    more = components(ends)
    if labels is None:
        return more
    further = _labelled(labels.withColumnRenamed("label", "_at"), more, "_at", "label").select("node", "label")
    return further.union(more.join(labels.select("node"), "node", "left_anti").select("node", "label"))


def _rest(left: DataFrame, sets: DataFrame, texts: DataFrame, percent: int, count: int) -> DataFrame:
    """Links (a, b) between members (h, sid, label) of one bucket and different labels, all pairs by their full sets.

    A label that fills more than a block in a bucket has blocks of its own, which never meet each other; the
    members of the other labels are dealt over mixed blocks. Every two blocks of a bucket are a task's group.
    """
    several = left.groupBy("h").agg(F.min("label").alias("_one"), F.max("label").alias("_two")).filter("_one != _two").select("h")
    left = materialize(left.join(several, "h").join(sets.select("sid", "n"), "sid"), "rest")
    fill = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    by_label = left.groupBy("h", "label").agg(fill.alias("own"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    fill = F.greatest(F.ceil(F.sum("c") / BLOCK_SETS), F.ceil(F.sum("s") / BLOCK_SHINGLES))
    mixed = by_label.filter("own = 1").groupBy("h").agg(fill.alias("mixed"))
    dealt = left.join(by_label.select("h", "label", "own"), ["h", "label"]).join(mixed, "h", "left")
    salt = F.pmod(F.xxhash64("sid", F.lit("block")), F.when(F.col("own") > 1, F.col("own")).otherwise(F.col("mixed")))
    dealt = materialize(dealt.select("h", "sid", "label", F.struct(F.when(F.col("own") > 1, F.col("label")).alias("whole"), salt.alias("salt")).alias("block")), "blocks")
    blocks = dealt.select("h", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "h").filter("x <= y and not coalesce(x.whole = y.whole, false)")
    pairs = pairs.withColumn("block", F.explode(F.array_distinct(F.array("x", "y"))))
    met = pairs.join(dealt, ["h", "block"]).select("h", "x", "y", (F.col("block") == F.col("y")).alias("second"), "sid", "label")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.tobytes() for own in shingle_sets(batch.column(1), count)], pa.binary())], ["sid", "hashes"])

    needed = texts.join(dealt.select("sid").distinct(), "sid", "left_semi").select("sid", "text")
    met = met.join(needed.mapInArrow(hashed, "sid binary, hashes binary"), "sid").select("h", "x", "y", "second", "sid", "label", "hashes")

    def compared(group: pa.Table) -> pa.Table:
        second = np.array(group["second"].to_pylist(), bool)
        names, labels = group["sid"].to_pylist(), group["label"].to_pylist()
        own = [np.frombuffer(v, np.uint64) for v in group["hashes"].to_pylist()]
        right = np.flatnonzero(second)
        same = second.all()  # a block with itself
        rows = right if same else np.flatnonzero(~second)
        common = common_counts([own[k] for k in rows], [own[k] for k in right])
        sizes = np.array([len(v) for v in own])
        hit = 100 * common >= percent * (sizes[rows][:, None] + sizes[right][None, :] - common)
        if same:
            hit &= np.tri(len(rows), k=-1, dtype=bool)
        edges = [(names[rows[i]], names[right[j]]) for i, j in zip(*np.nonzero(hit)) if labels[rows[i]] != labels[right[j]]]
        return pa.table({"a": pa.array([a for a, _ in edges], pa.binary()), "b": pa.array([b for _, b in edges], pa.binary())})

    return met.groupBy("h", "x", "y").applyInArrow(compared, "a binary, b binary").distinct()


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of one list has in common with each of the other."""
    out = np.zeros((len(one), len(two)), np.int64)
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (one, two)]
    owner = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (one, two)]
    both = np.intersect1d(*flat)
    if not len(both):
        return out
    for k in (0, 1):
        place = np.searchsorted(both, flat[k])
        order = np.argsort(place, kind="stable")
        order = order[both[np.minimum(place, len(both) - 1)][order] == flat[k][order]]
        flat[k], owner[k] = place[order], owner[k][order]
    for at in range(0, len(both), _SLICE):
        sides = []
        for k, n in ((0, len(one)), (1, len(two))):
            a, b = np.searchsorted(flat[k], (at, at + _SLICE))
            side = np.zeros((n, _SLICE), np.float32)
            side[owner[k][a:b], flat[k][a:b] - at] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def _named(rows: DataFrame, count: int) -> DataFrame:
    """Rows (id, text, sid) whose text has that very set; other texts under a repeated id go."""

    def run(batches):
        for batch in batches:
            keep = [set_name(own) == name for own, name in zip(shingle_sets(batch.column(1), count), batch.column(0).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.select("sid", "text").mapInArrow(run, "sid binary, text string").dropDuplicates(["sid"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, count: int = SHINGLE_WORDS, named: bool = False) -> DataFrame:
    """key, n_shingles, component_id, kept for each row; ``named`` adds sid, the name of its shingle set.

    Documents are linked if 100 * |common| >= percent * |union| of their shingle sets; component_id is the
    smallest key that can be reached, kept says that the row has it. Null or empty texts are linked with
    nothing. A row with a null key is linked with nothing, has a null component and is kept. Rows with equal
    keys are one document: they stay or go together if their texts are linked.
    """
    spark = docs.sparkSession
    with passing_tables(spark):
        rows = materialize(sketches(docs, key, text, count, band_rows(percent)), "sketches")
        sets = rows.filter(F.col("sid").isNotNull() & F.col("id").isNotNull()).groupBy("sid").agg(
            F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"),
        )
        sets = materialize(sets, "sets")
        labels = set_components(sets, docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")), percent, count)
        grouped = _labelled(sets.select("sid", "rep"), labels, "sid", "label")
        smallest = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
        grouped = grouped.join(smallest, "label").select("sid", "component_id")
        out = materialize(rows.select("id", "n_shingles", "sid").join(grouped, "sid", "left"), "components", lasting=True)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), *(["sid"] if named else []))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
