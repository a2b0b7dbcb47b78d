"""Source divergence audit by chunk factorization.

Texts are cut at white space and the chunks of each document counted. A task adds its documents up per language,
source and chunk before anything is shuffled: occurrences, distinct documents, and the first and last document
that has the chunk. Counts travel by buckets of chunks, columns compressed together, as a row for each count takes more than
twice the room. The counts of a chunk meet in its bucket, so that each globally distinct chunk is cut into terms once,
and its terms join all its counts there. There are more buckets than shuffle partitions, so a bucket is a share of a task.

A term is kept if it stands in at least ``least`` documents of the language. Documents of two chunks of a term may
be the same, so their numbers do not add up; but a chunk of one or two documents names them (first and last). A term is
sure if one chunk has enough documents by itself, or if the named ones fall on enough different bits of a mark; the others have
their named documents counted. So for ``least`` up to 3 the count is exact up to that threshold.

Shares are whole numbers of a billionth, smoothed over the kept terms. Sums over all kept terms are made of the terms
that a source has: terms that both lack add one constant, so no row is made for a term that a source lacks.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.arrays import row_blocks
from clausegrid.session import materialize

#: Bytes of text whose words a task counts at once; a longer text is a block of its own.
HELD = 16 << 20
#: Bytes that a row takes of it besides its text.
ROW_BYTES = 64
#: Documents that a chunk can name.
MOST_LEAST = 3
SCALE = 1_000_000_000
#: Terms of a source that the report lists.
LISTED = 200

#: Buckets of chunks for each shuffle partition.
BUCKETS = 4
PART = pa.schema([*[(c, pa.binary()) for c in ("lang", "source", "chunk")], *[(c, pa.int64()) for c in ("n", "docs", "first", "span")]])

# Fixed value: a term is a run of ASCII letters and characters beyond ASCII; the other bytes become blanks.
BLANKED = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def chunk_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, part, as often as a task hands on: ``part`` has the counts of all chunks whose hash falls on the bucket.

    A part is a compressed Arrow batch of lang, source, chunk, n (occurrences), docs, first (document number) and span (from the
    first to the last). Nulls are empty; A-Z are lower-cased. A row is a document, also if it repeats another.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def handed(block: pa.Table, number: int):
        packed = pa.ipc.IpcWriteOptions(compression="zstd")
        codes: dict[tuple, int] = {}
        group = np.array([codes.setdefault(own, len(codes)) for own in zip(*(block[c].to_pylist() for c in ("lang", "source")))], np.int64)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(block["text"].cast(pa.large_string()).combine_chunks()))
        words = lists.flatten()
        solid = pc.not_equal(pc.binary_length(words), 0)
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[solid.to_numpy(zero_copy_only=False)]
        words = words.filter(solid).dictionary_encode()
        chunks = words.dictionary.cast(pa.large_binary())
        if not len(chunks):
            return
        of = np.fromiter(map(crc32, chunks.to_pylist()), np.int64, len(chunks)) % buckets
        order = np.argsort(of, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # One number for a word in a document: chunks by bucket, then groups, then documents.
        key = (place[words.indices.to_numpy()] * len(codes) + group[doc]) * len(lists) + doc
        key.sort()
        pairs = np.flatnonzero(np.diff(key, prepend=-1))
        key, doc = np.divmod(key[pairs], len(lists))
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        docs = np.diff(begin, append=len(key))
        n = np.diff(pairs[begin], append=len(words))
        first, last = doc[begin], doc[begin + docs - 1]
        chunk, group = np.divmod(key[begin], len(codes))
        ends = np.searchsorted(of[order][chunk], np.arange(buckets), "right")
        names = [pa.array([own[k] for own in codes], pa.string()).cast(pa.binary()).take(pa.array(group)) for k in (0, 1)]
        chunk = chunks.take(pa.array(order[chunk])).cast(pa.binary())
        batch = pa.RecordBatch.from_arrays([*names, chunk, *map(pa.array, (n, docs, first + number, last - first))], schema=PART)
        for k in np.flatnonzero(np.diff(ends, prepend=0)):
            begin = ends[k - 1] if k else 0
            with pa.ipc.new_stream(sink := pa.BufferOutputStream(), PART, options=packed) as stream:
                stream.write_batch(batch.slice(begin, ends[k] - begin))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "part"])

    def run(batches):
        number, waiting, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) + ROW_BYTES
            for a, b in row_blocks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), HELD):
                size = int(sizes[a:b].sum())
                if waiting and held + size > HELD:
                    block = pa.Table.from_batches(waiting)
                    yield from handed(block, number)
                    number, waiting, held = number + len(block), [], 0
                waiting.append(batch.slice(a, b - a))
                held += size
        if waiting:
            yield from handed(pa.Table.from_batches(waiting), number)

    return rows.mapInArrow(run, "bucket int, part binary")


def term_rows(counted: DataFrame) -> DataFrame:
    """lang, source, term, n, docs, first, last from the parts of each bucket.

    The counts of a chunk, one for each lang and source, meet in its bucket, where the chunk is cut once. A chunk
    that holds a term several times counts it as often.
    """

    def run(parts: pa.Table) -> pa.Table:
        read = [pa.ipc.open_stream(part).read_next_batch() for part in parts["part"].to_pylist()]
        rows = pa.Table.from_batches(read)
        last = pc.add(rows["first"], rows["span"])
        rows = rows.drop_columns(["span"]).append_column("last", last).group_by(["chunk", "lang", "source"], use_threads=False)
        rows = rows.aggregate([("n", "sum"), ("docs", "sum"), ("first", "min"), ("last", "max")]).combine_chunks()
        rows = rows.rename_columns([c.partition("_")[0] for c in rows.column_names])
        chunks = pc.dictionary_encode(rows["chunk"]).combine_chunks()
        terms = [c.translate(BLANKED).split() for c in chunks.dictionary.to_pylist()]
        ends = np.cumsum([0, *map(len, terms)])
        at = chunks.indices.to_numpy()
        times = np.diff(ends)[at]
        row = np.repeat(np.arange(len(at)), times)
        term = np.arange(len(row)) + np.repeat(ends[at] - (np.cumsum(times) - times), times)
        rows = rows.take(pa.array(row))
        term = pa.array([t for own in terms for t in own], pa.binary()).take(pa.array(term))
        texts = [x.cast(pa.string()) for x in (rows["lang"], rows["source"], term)]
        return pa.table([*texts, *(rows[c] for c in ("n", "docs", "first", "last"))], ["lang", "source", "term", "n", "docs", "first", "last"])

    return counted.groupBy("bucket").applyInArrow(run, "lang string, source string, term string, n long, docs long, first long, last long")


def term_counts(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(groups, kept): lang, source of every group that occurs; lang, source, term, n, whole, leads of the
    terms that stand in at least ``least`` documents of the language, for the sources that have them. ``whole`` is
    n for the language, and one row of each term of a language leads."""
    if not 1 <= least <= MOST_LEAST:
        raise ValueError(f"least is {least}; a chunk names at most {MOST_LEAST - 1} documents, so 1 to {MOST_LEAST} can be told")
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(term_rows(chunk_counts(docs, buckets)), "terms")
    marks = F.bit_or(_mark("first").bitwiseOR(_mark("last")))
    own = rows.repartition("lang", "term").groupBy("lang", "term", "source")
    own = own.agg(F.sum("n").alias("n"), F.max("docs").alias("most"), F.sum("docs").alias("all"), marks.alias("marks"))
    term = Window.partitionBy("lang", "term")
    sure = (F.max("most").over(term) >= least) | (F.bit_count(F.bit_or("marks").over(term)) >= least)
    counts = own.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("whole"), (F.col("source") == F.min("source").over(term)).alias("leads"),
        F.sum("all").over(term).alias("all"), sure.alias("sure"),
    )
    counts = materialize(counts.filter(F.col("all") >= least).drop("all"), "counts")
    unsure = materialize(counts.filter(~F.col("sure") & F.col("leads")).select("lang", "term"), "unsure")
    named = rows.join(unsure, ["lang", "term"]).select("lang", "term", F.explode(F.array("first", "last")).alias("doc")).distinct()
    found = materialize(named.groupBy("lang", "term").agg(F.count("doc").alias("named")).filter(F.col("named") >= least).select("lang", "term"), "found")
    kept = counts.filter("sure").union(counts.filter("not sure").join(found, ["lang", "term"], "left_semi").select(*counts.columns)).drop("sure")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    return groups, kept


def _mark(doc: str) -> Column:
    """One of 64 bits for a document number: different bits are different documents."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(doc), F.lit(64)).cast("int"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any counts."""
    n, total, terms = (x.cast("decimal(19,0)") for x in (n, total, terms))
    return 1 + F.call_function("div", (n + 1) * F.lit(SCALE).cast("decimal(10,0)"), total + terms)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q) of two shares."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = 3, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the divergence of a source from each other source of its language, over all kept terms. Part
    ``term``: up to ``listed`` kept terms that the source uses more than its language does. Ranks run by value from the
    largest, then by item. A language without kept terms has pairs of value 0; without documents there are no rows.
    """
    groups, counts = term_counts(docs, least)
    zero = F.lit(0).cast("long")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.sum(F.col("leads").cast("long")).alias("led"))
    totals = materialize(totals, "totals")
    terms = totals.groupBy("lang").agg(F.sum("led").alias("v"), F.sum("own").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("own", "v", "total")])
    floor = F.when(F.col("v") > 0, share(zero, F.col("own"), F.greatest("v", F.lit(1)))).otherwise(F.lit(1).cast("long"))
    groups = materialize(groups.withColumn("p0", floor), "groups")
    shares = counts.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("own"), F.col("v")), share(F.col("whole"), F.col("total"), F.col("v"))
    shares = materialize(shares.select("lang", "source", "term", p.alias("p"), q.alias("q"), "p0"), "shares")
    both = _pairs(groups, shares).withColumn("part", F.lit("pair"))
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)
    pairs = both.select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(ranked)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (another source), value.

    The gap of two sources over all v kept terms is v gaps of their floors p0, corrected for the terms that one of
    them has (a histogram of each source's shares meets the other floors) and for those that both have.
    """
    one = groups.select("lang", "source", "v", F.col("p0").alias("p0_a"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("p0_b"))
    ends = one.join(two, "lang").filter("source <> item")
    base = F.col("p0_a"), F.col("p0_b")
    start = ends.select("lang", "source", "item", (F.col("v") * gap(*base)).alias("value"))
    kinds = materialize(shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")), "kinds")
    own = ends.join(kinds, ["lang", "source"]).select("lang", "source", "item", (F.col("times") * (gap(F.col("p"), base[1]) - gap(*base))).alias("value"))
    other = ends.join(kinds.withColumnRenamed("source", "item"), ["lang", "item"]).select("lang", "source", "item", (F.col("times") * (gap(base[0], F.col("p")) - gap(*base))).alias("value"))
    found = F.array_sort(F.collect_list(F.struct("source", "p", "p0"))).alias("found")
    held = shares.select("lang", "term", "source", "p", "p0").groupBy("lang", "term").agg(found).filter(F.size("found") > 1)
    held = held.select("lang", "found", F.posexplode("found").alias("k", "x"))
    held = held.select("lang", "x", F.explode(F.slice("found", F.col("k") + 2, F.size("found"))).alias("y"))
    x, y = F.col("x"), F.col("y")

    def corrected(a: Column, b: Column) -> Column:
        return gap(a["p"], b["p"]) - gap(a["p"], b["p0"]) - gap(a["p0"], b["p"]) + gap(a["p0"], b["p0"])

    common = held.groupBy("lang", x["source"].alias("one"), y["source"].alias("two")).agg(F.sum(corrected(x, y)).alias("there"), F.sum(corrected(y, x)).alias("back"))
    there = F.struct(F.col("one").alias("source"), F.col("two").alias("item"), F.col("there").alias("value"))
    back = F.struct(F.col("two").alias("source"), F.col("one").alias("item"), F.col("back").alias("value"))
    common = common.select("lang", F.inline(F.array(there, back)))
    every = start.union(own.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    every = every.union(other.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))).union(common)
    return every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
