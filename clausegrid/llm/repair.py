"""Conversation structure repair: weighted CYK parsing over spans of rows.

The target structure, an optional system row and then user and assistant rows in turn, is the grammar of a
small automaton. In Chomsky normal form its symbols are pairs (p, q) of states with the rules
(p, q) -> (p, r) (r, q); a row derives (p, q) by keeping, re-roling or deleting it, at a cost. A cell of a span holds
for each symbol the least (cost, audit), the audit being the initials of the edits in order. Insertions are
closed over in the cells of single rows, so that longer spans need no rule for them.

Cells are combined bottom-up by span length. Any split of a span gives the same least cell: symbols are state
pairs, and of two audits of equal cost over the same rows none begins the other (it would hold more insertions, which
cost), so the order survives concatenation. Hence spans of length 1, 2, 4, ... suffice, and a conversation of
n rows has 2 n cells instead of n * n.

Rows are ordered in written ranges that ignore where a conversation ends, and each is reduced to one letter
(role class and fault). Blocks of letters are put together to one text per conversation, as long as its audit. Only
the digest of the repaired rows needs a conversation's texts in one task; they stream through it in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.session import materialize

#: Cost of each edit; a truncated row that stays adds TRUNCATED.
RECAST, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
STATES, FINAL = 4, (0, 3)
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ROLE = {"u": "user", "a": "assistant"}
#: Rows of a block of letters.
BLOCK = 4096

# Role initials of the target, other roles count as x; faults in the order in which they are looked for.
CLASSES, FAULTS = "suax", ("", "blank", "duplicate", "truncated")

Cell = dict[tuple[int, int], tuple[int, str]]


def letter(initial: Column, fault: Column) -> Column:
    """One letter for a row: 4 * class + fault, counted from A."""
    number = F.lit(3) * 4
    for k, c in enumerate("sua"):
        number = F.when(initial == c, k * 4).otherwise(number)
    return F.chr(F.lit(65) + number + fault)


def read_letter(x: str) -> tuple[str, int]:
    """(class, fault) of a letter."""
    kind, fault = divmod(ord(x) - 65, 4)
    return CLASSES[kind], fault


def _better(cell: Cell, symbol: tuple[int, int], found: tuple[int, str]) -> None:
    if symbol not in cell or found < cell[symbol]:
        cell[symbol] = found


def _insertions() -> Cell:
    """The cell of no rows: for each symbol the fewest insertions."""
    cell: Cell = {(p, p): (0, "") for p in range(STATES)}
    for _ in range(STATES):
        for (p, q), (cost, audit) in list(cell.items()):
            for c in "ua":
                if q in _NEXT[c]:
                    _better(cell, (p, _NEXT[c][q]), (cost + INSERT, audit + "I"))
    return cell


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = {}
    for (p, r), (c1, a1) in left.items():
        for (r2, q), (c2, a2) in right.items():
            if r == r2:
                _better(out, (p, q), (c1 + c2, a1 + a2))
    return out


def row_cell(x: str) -> Cell:
    """The cell of one row, closed under insertions on both sides."""
    kind, fault = read_letter(x)
    cell: Cell = {(p, p): (DELETE, "D") for p in range(STATES)}
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        for p, q in _NEXT.get(kind, {}).items():
            _better(cell, (p, q), (more, "K"))
        for c in "ua":
            for p, q in _NEXT[c].items():
                _better(cell, (p, q), (more + RECAST, "R"))
    closure = _insertions()
    return combine(combine(closure, cell), closure)


def parse(letters: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation; ties go to the least audit.

    Neighbouring spans are combined by doubling length, so a row takes part in as many as there are doublings.
    """
    if not letters:
        return 0, ""
    rows = {x: row_cell(x) for x in set(letters)}
    spans = [rows[x] for x in letters]
    while len(spans) > 1:
        spans = [combine(spans[k], spans[k + 1]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return min(spans[0][0, q] for q in FINAL if (0, q) in spans[0])


def repaired_rows(audit: str, rows):
    """(role, text) of the repaired conversation; ``rows`` gives (role, text) in order."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            role, text = _ROLE["a" if state == 2 else "u"], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = _ROLE["a" if state == 2 else "u"]
        state = _NEXT[role[0]][state]
        yield role, text


def damage(rows: DataFrame) -> DataFrame:
    """Rows with null role and text as one blank, damaged by crc32(``conv_id:turn``) % 20: 0 drops the row, 1
    empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it a user row. A null in the key is one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), blank)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), blank))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("_kind", kind).filter("_kind <> 0")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """With ``conv``, a name of the conversation that is never null."""
    name = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))
    return rows.withColumn("conv", name)


def _order() -> list[Column]:
    """Order of rows within a conversation."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, at (place in the order of all rows), letter. ``rows``: conv, turn, role, text.

    Rows of a conversation follow turn (nulls first), role, text; ``at`` rises with it and is written down.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    same = F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256)
    order = [F.col("conv"), *_order()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), same.alias("same"), F.monotonically_increasing_id().alias("at"))
    ordered = materialize(ordered, "turns")
    first = ordered.groupBy("conv", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    joined = ordered.join(first, "at", "left")
    fault = F.when(F.col("fault") == 1, 1).when(F.col("first").isNull(), 2).otherwise(F.col("fault"))
    return joined.select("conv", "turn", "at", letter(F.col("initial"), fault).alias("letter"))


def letters(rows: DataFrame) -> DataFrame:
    """conv, letters: one text per conversation from blocks of bounded size. ``rows``: conv, at, letter."""
    block = F.expr(f"at div {BLOCK}")
    glue = "array_join(transform(array_sort(collect_list(struct(at, letter))), x -> x.letter), '')"
    blocks = rows.groupBy("conv", block.alias("at")).agg(F.expr(glue).alias("letter"))
    return blocks.groupBy("conv").agg(F.expr(glue).alias("letters"))


def parsed(conversations: DataFrame) -> DataFrame:
    """conv, blank, duplicate, truncated, illegal, cost, audit from conv, letters (null: no rows)."""

    def judged(text):
        read = [read_letter(x) for x in text]
        counts = [sum(f == k for _, f in read) for k in (1, 2, 3)]
        pairs = (a[0] + b[0] for a, b in zip(read, read[1:]))
        return *counts, sum(x not in ("su", "ua", "au") for x in pairs), *parse(text)

    def run(batches):
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            known = {text: judged(text) for text in set(texts)}
            out = [known[text] for text in texts]
            made = [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 5 + [pa.string()])] if out else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    kinds = ", ".join(f"{c} long" for c in ("blank", "duplicate", "truncated", "illegal", "cost"))
    return conversations.select("conv", "letters").mapInArrow(run, f"conv string, {kinds}, audit string")


def _streamed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its rows in order, conversations kept whole in a task, which streams them."""
    told = audits.select("conv", F.lit(0).alias("row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = told.union(rows.select("conv", F.lit(1).alias("row"), "turn", "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "row", *_order())


def _by_conversation(batches):
    """(conv, audit, rows) for sorted batches; rows come from the stream and must be used up before the next."""

    def flat():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)))

    stream = flat()
    ahead = next(stream, None)
    while ahead is not None:
        conv, audit = ahead[0], ahead[3]

        def own():
            nonlocal ahead
            while (ahead := next(stream, None)) is not None and ahead[0] == conv:
                yield ahead[2], ahead[3]

        rows = own()
        yield conv, audit, rows
        for _ in rows:
            pass


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, position, role, text: the repaired conversations, a row each. Conversations stream, none is held whole."""

    def run(batches):
        out = []
        for conv, audit, own in _by_conversation(batches):
            for k, (role, text) in enumerate(repaired_rows(audit, own)):
                out.append((conv, k, role, text))
                if len(out) == 1024:
                    yield _batch(out, "conv position role text", [pa.string(), pa.int64(), pa.string(), pa.string()])
                    out = []
        if out:
            yield _batch(out, "conv position role text", [pa.string(), pa.int64(), pa.string(), pa.string()])

    return _streamed(rows, audits).mapInArrow(run, "conv string, position long, role string, text string")


def _batch(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names.split())


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the lines role:text of each repaired conversation."""

    def run(batches):
        out = []
        for conv, audit, own in _by_conversation(batches):
            told = hashlib.sha256()
            for k, (role, text) in enumerate(repaired_rows(audit, own)):
                told.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            out.append((conv, told.hexdigest()))
            if len(out) == 1024:
                yield _batch(out, "conv repaired_sha256", [pa.string(), pa.string()])
                out = []
        if out:
            yield _batch(out, "conv repaired_sha256", [pa.string(), pa.string()])

    return _streamed(rows, audits).mapInArrow(run, "conv string, repaired_sha256 string")


def audit_conversations(rows: DataFrame, original: DataFrame) -> DataFrame:
    """conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for every conversation of ``original``.

    ``rows`` (conv_id, turn, role, text, no nulls in the last two) are what is left of them; a conversation without rows
    has zeros and an empty audit. A null conv_id is a conversation of its own; a null turn comes first
    and leaves no gap; repeated rows are duplicates; an empty role fits no place, so its row is re-roled or deleted.
    """
    judged = materialize(faults(_keyed(rows)), "faults")
    turns = judged.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    every = _keyed(original.select("conv_id").distinct())
    told = parsed(every.select("conv").join(letters(judged), "conv", "left"))
    out = every.join(told, "conv").join(turns, "conv", "left")
    counts = [F.coalesce(F.col("gaps").cast("long"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return out.select("conv", "conv_id", *counts)


def repair(rows: DataFrame, original: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows): see ``audit_conversations`` and ``repaired``; null roles and texts count as one blank."""
    blank = F.lit(" ")
    clean = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    audits = materialize(audit_conversations(clean, rows if original is None else original), "audits")
    return audits, repaired(_keyed(clean), audits)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit and repaired_sha256 of every conversation after ``damage``."""
    rows = damage(conversations)
    audits = materialize(audit_conversations(rows, conversations), "audits")
    told = digests(_keyed(rows), audits)
    return audits.join(told, "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
