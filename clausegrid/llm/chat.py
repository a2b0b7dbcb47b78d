"""Reply trees as chat text: root-to-leaf paths by self-joins, best branches first, one conversation a path.

Self-joins double the reach each round: after k rounds a message knows its ancestor 2^k replies up and the
score on the way, so a thread of n replies takes log2(n) rounds. The written tables of the rounds are then
walked back from long to short reach and list the messages of the chosen paths only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.session import materialize

OPEN, MIDDLE, CLOSE = "<turn:", ">", "</turn>\n"
MAX_ROUNDS = 62


def escape(text: Column) -> Column:
    """No angle bracket is left, so no text can open or close a turn."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def thread(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn-ordered rows as messages (tree, node, parent, score, role, text): each turn answers the one in front.

    Rows with a null tree are one conversation; null turns come first; equal turns go by role, then text, and
    repeated rows stay. Null role or text is empty.
    """
    key = F.col(tree).cast("string")
    full = rows.select(
        F.concat(F.when(key.isNull(), "-").otherwise("+"), F.coalesce(key, F.lit(""))).alias("tree"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")).cast("long")
    numbered = full.withColumn("node", place)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """Messages (tree, node, parent, score, ...) to (tree, leaf, branch_rank, branch_score, depth, node).

    Every leaf is a path, ranked within its tree by the sum of the scores on it (null: 0), then by leaf.
    ``keep`` is the number of paths a tree keeps, None for all. A parent that does not exist makes a root.
    Nodes are unique within a tree and not null; a circle of replies is an error.
    """
    links = messages.select("tree", "node", F.col("parent").alias("up"), F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("size"))
    known = links.select("tree", F.col("node").alias("up"), F.lit(True).alias("_there"))
    links = links.join(known, ["tree", "up"], "left").withColumn("up", F.when(F.col("_there"), F.col("up")))
    start = materialize(links.select("tree", "node", "up", "total", "size"), "reach")
    steps, done = [start.filter(F.col("up").isNotNull())], start.filter(F.col("up").isNull())
    while not steps[-1].isEmpty():
        if len(steps) > MAX_ROUNDS or (1 << len(steps)) > 2 * max(2, start.count()):
            raise ValueError("replies form a circle")
        far = steps[-1].union(done)
        far = far.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("size").alias("_size"))
        both = steps[-1].join(far, ["tree", "up"])  # messages that have reached their root take no further part
        both = both.select("tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("size") + F.col("_size")).alias("size"))
        both = materialize(both, "reach")
        steps.append(both.filter(F.col("up").isNotNull()))
        done = done.union(both.filter(F.col("up").isNull()))
    replied = start.filter(F.col("up").isNotNull()).select("tree", F.col("up").alias("node"))
    leaves = done.join(replied, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(order).cast("long"))
    if keep is not None:
        leaves = leaves.filter(F.col("branch_rank") <= keep)
    leaves = materialize(leaves.select("tree", F.col("node").alias("leaf"), "branch_rank", F.col("total").alias("branch_score"), "size"), "leaves")
    walked = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("hops"))
    for k in reversed(range(len(steps) - 1)):
        jump = steps[k].select("tree", "node", "up")
        further = walked.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("hops") + (1 << k)).alias("hops"))
        walked = materialize(walked.union(further), "walk")
    return walked.join(leaves, ["tree", "leaf"]).select("tree", "leaf", "branch_rank", "branch_score", (F.col("size") - F.col("hops")).alias("depth"), "node")


def format_paths(messages: DataFrame, chosen: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row a path: tree, leaf, branch_rank, branch_score, formatted, loss (start and length of each span).

    A turn is ``<turn:role>text</turn>`` and a line feed, with ``&``, ``<`` and ``>`` escaped in role and
    text. Loss spans cover the escaped texts of the role ``learn``, in code points of the formatted text.
    """
    turns = chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.withColumn("_head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).withColumn("_body", escape(F.col("text")))
    turns = turns.withColumn("_size", F.length("_head") + F.length("_body") + len(CLOSE))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)) + F.length("_head"))
    span = F.when(F.col("role") == learn, F.struct(F.col("_start").alias("start"), F.length("_body").cast("long").alias("length")))
    grouped = turns.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(
        F.sort_array(F.collect_list(F.struct("depth", F.concat("_head", "_body", F.lit(CLOSE)).alias("piece")))).alias("_pieces"),
        F.sort_array(F.collect_list(span)).alias("loss"),
    )
    return grouped.select("tree", "leaf", "branch_rank", "branch_score", F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    pieces = F.split(formatted, CLOSE, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def one(piece):
        inner = F.substr(piece, F.lit(len(OPEN) + 1), F.length(piece))
        role = F.substring_index(inner, MIDDLE, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(inner, F.length(role) + len(MIDDLE) + 1, F.length(inner))).alias("text"))

    return F.transform(whole, one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss spans, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
