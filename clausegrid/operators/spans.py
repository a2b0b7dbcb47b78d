"""Spans in texts: extraction by pattern, preparation of annotations, scores, decomposition of actions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import lexicon as L
from clausegrid.functions.segment import let, sentences

_NB = L.NON_BLANK
_B = L.BLANK


def _words(words: Sequence[str]) -> str:
    return "|".join(words)


def lexicon_pattern(lexicon: Sequence[str] = tuple(L.MODALS)) -> str:
    """One of the words, standing alone."""
    edge = r"[^\p{L}\p{N}_]"
    return rf"(?i)(?:^|{edge})(?:{_words(lexicon)})(?:$|{edge})"


def extract_spans(df: DataFrame, key: str, col: str, pattern: str, stops: str = "[.;]") -> DataFrame:
    """(key, pos, obl): the stretches between stops in which the pattern occurs.

    One row per stretch, trimmed; texts without any give no row. Cutting first and
    testing each stretch takes time linear in the text, whatever the pattern starts with.
    """
    parts = F.transform(F.split(col, stops, -1), lambda s: F.regexp_replace(s, f"^{_B}+|{_B}+$", ""))
    return df.select(key, F.posexplode(F.filter(parts, lambda s: s.rlike(pattern))).alias("pos", "obl"))


def extract_spans_with(df: DataFrame, key: str, col: str, find, schema: str) -> DataFrame:
    """Spans by a model: ``find`` maps an Arrow batch of (key, col) to rows of ``schema``."""
    return df.select(key, col).mapInPandas(lambda batches: (find(b) for b in batches), schema)


def relabel(spans: str | Column, keep: Sequence[str], label: str) -> Column:
    """Spans with one of the kept labels, all under one label."""
    kept = F.filter(spans, lambda s: s["label"].isin(list(keep)))
    return F.transform(kept, lambda s: F.struct(s["start"], s["end"], F.lit(label).alias("label")))


#: Characters at the end of a text that are looked at first.
_END = 256


def _ending(c: Column, pattern: str) -> Column:
    """Length of what a pattern like ``x*$`` matches at the end of a text. Only texts whose last characters match
    throughout are read from the front, so the cost does not grow with the text in front."""
    def length(t: Column) -> Column:
        return F.length(F.regexp_extract(t, pattern, 0))

    def seen(t: Column) -> Column:
        return let(length(t), lambda n: F.when(n < F.length(t), n).otherwise(length(c)))

    return let(F.right(c, F.lit(_END)), seen)


def trim_spans(spans: str | Column, text: str | Column) -> Column:
    """Move span ends inwards past blanks."""
    text = F.col(text) if isinstance(text, str) else text

    def trimmed(s: Column) -> Column:
        piece = F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        lead = F.length(F.regexp_extract(piece, f"^{_B}*", 0))
        tail = _ending(piece, f"{_B}*$")
        start = F.least(s["start"] + lead, s["end"])
        return F.struct(start.alias("start"), F.greatest(s["end"] - tail, start).alias("end"), s["label"].alias("label"))

    return F.transform(spans, trimmed)


def contract_spans(spans: str | Column, text: str | Column) -> Column:
    """Shrink spans to the whole words inside them; spans without a whole word go."""
    text = F.col(text) if isinstance(text, str) else text

    def inside(s: Column) -> Column:
        at = F.substr(text, s["start"].cast("int") + 1)
        cut_word = (s["start"] > 0) & F.substr(text, s["start"].cast("int"), F.lit(1)).rlike(f"^{_NB}")
        skip = F.when(cut_word, F.regexp_extract(at, f"^{_NB}*{_B}*", 0)).otherwise(F.regexp_extract(at, f"^{_B}*", 0))
        head = F.left(text, s["end"].cast("int"))
        open_word = F.substr(text, s["end"].cast("int") + 1, F.lit(1)).rlike(f"^{_NB}")
        kept = F.when(open_word, F.left(head, F.length(head) - _ending(head, f"{_NB}*$"))).otherwise(head)
        end = let(kept, lambda k: F.length(k) - _ending(k, f"{_B}*$")).cast("bigint")
        return F.struct((s["start"] + F.length(skip)).alias("start"), end.alias("end"), s["label"].alias("label"))

    return F.filter(F.transform(spans, inside), lambda s: s["start"] < s["end"])


def drop_overlaps(spans: Column) -> Column:
    """Keep a span unless it overlaps one kept before, in list order."""

    def step(kept: Column, s: Column) -> Column:
        clash = F.exists(kept, lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(s)))

    return let(spans, lambda x: F.aggregate(x, F.slice(x, 1, 0), step))


def prepare_spans(df: DataFrame, key: str, text: str, spans: str, keep: Sequence[str], label: str) -> DataFrame:
    """(key, start, end, label): relabelled, trimmed to words, without overlaps."""
    ready = drop_overlaps(contract_spans(trim_spans(relabel(spans, keep, label), text), text))
    return df.select(key, F.explode(ready).alias("s")).select(key, "s.start", "s.end", "s.label")


def find_span(text: str | Column, tag: str | Column) -> Column:
    """(start, end) of the first occurrence of a tag, null if it is missing."""
    at = F.position(tag, text)
    hit = F.struct((at - 1).alias("start"), (at - 1 + F.length(tag)).alias("end"))
    return F.when(at > 0, hit)


def action_pattern(lexicon: Sequence[str]) -> str:
    """Optional condition up to a comma, subject, modal with optional "not", verb, rest."""
    return (
        rf"(?i)^(?:((?:if|where|when|unless|in case)\b[^,]*),)?{_B}*([^,]*?){_B}+"
        rf"((?:{_words(lexicon)})(?:{_B}+not)?){_B}+({_NB}+)(?:{_B}+(.*))?$"
    )


def action_decompose(df: DataFrame, key: str, col: str, lexicon: Sequence[str] = tuple(L.MODALS)) -> DataFrame:
    """(key, pos, condition, subject, modal, verb, object) per sentence; nulls where no modal is found."""
    rows = df.select(key, F.posexplode(sentences(F.regexp_replace(col, r"\n", " "))).alias("pos", "sentence"))
    hit = rows.withColumn("_hit", F.col("sentence").rlike(action_pattern(lexicon)))

    def part(i: int, name: str) -> Column:
        return F.when(F.col("_hit"), F.regexp_extract("sentence", action_pattern(lexicon), i)).alias(name)

    names = ["condition", "subject", "modal", "verb", "object"]
    return hit.select(key, "pos", *[part(i + 1, n) for i, n in enumerate(names)])


def span_score(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """(label, tp, fp, fn, p, r, f) per label; keys identify a span and include ``label``."""
    a = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    b = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    both = a.join(b, keys, "full_outer")
    counts = both.groupBy("label").agg(
        F.count(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("_g").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("_p").isNull(), 1)).alias("fn"),
    )

    def share(n: Column, d: Column) -> Column:
        return F.when(d > 0, n / d).otherwise(F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "label", "tp", "fp", "fn",
        share(tp, tp + fp).alias("p"), share(tp, tp + fn).alias("r"), share(2 * tp, 2 * tp + fp + fn).alias("f"),
    )
