import re
import string
import unicodedata

import pytest
from pyspark.sql import functions as F

from clausegrid.functions import lexicon as L
from clausegrid.functions import segment as G
from clausegrid.functions import text as X
from clausegrid.operators import tokens as K
from clausegrid.plans.clause_table import national_clauses, treaty_clauses

SAMPLES = [
    "Ünïcode ﬁle ½ Straße œuvre ＡＢＣ ㎏ ①", "plain ascii", "", "  a b c\x1cd  ", "Àé́x 𝐀𝐁 ﷺ",
    "see www.x.org and http://y.z/a?b=1 (a) first iv) second 17 99 3.14 118",
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "id int, t string").orderBy("id")


def run(df, col):
    return [r[0] for r in df.select(col.alias("x")).collect()]


def test_ascii_fold(samples):
    want = [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in SAMPLES]
    assert run(samples, X.ascii_fold("t")) == want


def test_blanks_and_tokens(samples):
    assert run(samples, X.squeeze_blanks("t")) == [" ".join(s.split()) for s in SAMPLES]
    assert run(samples, X.tokens("t")) == [s.split() for s in SAMPLES]


def test_simple_steps(samples):
    assert run(samples, X.remove_punctuation("t")) == [s.translate(str.maketrans("", "", string.punctuation)) for s in SAMPLES]
    assert run(samples, X.remove_number("t")) == [re.sub(r"\d+", "", s) for s in SAMPLES]
    assert run(samples, X.remove_url("t")) == [re.sub(r"(www|http)\S+", "", s) for s in SAMPLES]
    assert run(samples, X.drop_cardinals("t"))[-1].endswith("second   3.14 ")


def test_chain_counts_null_as_empty_and_knows_its_steps(spark):
    df = spark.createDataFrame([(None,), ("A 1",)], "t string")
    assert run(df, X.clean("t", ["to_lower", "remove_number", "remove_whitespace"])) == ["", "a"]
    with pytest.raises(KeyError):
        X.clean("t", ["no_such_step"])


def test_number_words_leave_remainders(spark):
    df = spark.createDataFrame([("chapter sixteen and twenty",)], "t string")
    assert run(df, X.strip_number_words("t")) == ["chapter teen and "]


PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size",
    "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam",
    "operator": "oper", "hopefulness": "hope", "triplicate": "triplic", "formative": "form", "electrical": "electr",
    "revival": "reviv", "allowance": "allow", "adjustment": "adjust", "adoption": "adopt", "effective": "effect",
    "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll", "dying": "die", "obligations": "oblig",
    "parties": "parti", "trading": "trade", "by": "by", "apology": "apolog",
}


def test_porter_stems(spark):
    df = spark.createDataFrame([(w,) for w in PORTER], "token string")
    assert {r.token: r.stem for r in K.stem_vocabulary(df).collect()} == PORTER


def test_stem_text_keeps_order_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "Parties agreed  trading"), (2, " ")], "id int, t string")
    assert {r.id: r.stemmed for r in K.stem_text(df, "id", "t").collect()} == {1: "parti agre trade", 2: ""}


def test_joined_words(spark):
    vocab = spark.createDataFrame([("investment", 50), ("protection", 40), ("in", 90), ("rules", 9)], "token string, n long")
    words = spark.createDataFrame([("investmentprotection",), ("rules",), ("zzz",)], "w string")
    got = {r.word: (r.left, r.right) for r in K.split_joined(words, "w", vocab).collect()}
    assert got == {"investmentprotection": ("investment", "protection"), "rules": (None, None), "zzz": (None, None)}


def test_words_of_any_number_of_parts(spark):
    rows = [("trade", 30), ("in", 90), ("investment", 50), ("goods", 20), ("and", 99), ("services", 25), ("tradein", 1), ("a", 5), ("", 7)]
    vocab = spark.createDataFrame(rows, "token string, n long")
    glued = ["tradeingoodsandservices", "tradeingoods", "investment", "goodsx", "a", "", None, "tradein", "tradein"]
    words = spark.createDataFrame([(w,) for w in glued], "w string")
    got = {r.word: r.parts for r in K.split_words(words, "w", vocab).collect()}
    assert got == {
        "tradeingoodsandservices": ["trade", "in", "goods", "and", "services"], "tradeingoods": ["trade", "in", "goods"],
        "investment": None, "goodsx": None, "a": None, "": None, "tradein": ["trade", "in"],
    }
    assert {r.parts for r in K.split_words(words, "w", vocab.limit(0)).collect()} == {None}


def test_parts_are_the_cheapest_of_all_ways(spark):
    """All ways to spell the words of up to nine letters over a small alphabet, ties too, and one very long word."""
    import itertools
    import math

    count = {"a": 4, "b": 4, "ab": 4, "ba": 1, "aab": 3, "abab": 2, "bb": 1}
    total = sum(count.values())
    cost = {t: round(math.log(total / n) * 1e6) for t, n in count.items()}

    def ways(word):
        if not word:
            yield []
        for t in count:
            if word.endswith(t):
                for head in ways(word[: len(word) - len(t)]):
                    yield head + [t]

    def rank(parts):
        starts = list(itertools.accumulate([0] + [len(t) for t in parts[:-1]]))
        return sum(cost[t] for t in parts), len(parts), starts[::-1]

    words = ["".join(w) for n in range(1, 10) for w in itertools.product("abc" if n < 5 else "ab", repeat=n)]
    want = {}
    for w in words:
        best = min(ways(w), key=rank, default=[])
        want[w] = best if len(best) > 1 else None
    vocab = spark.createDataFrame(list(count.items()), "token string, n long")
    got = {r.word: r.parts for r in K.split_words(spark.createDataFrame([(w,) for w in words], "w string"), "w", vocab).collect()}
    assert got == want
    long = K.split_words(spark.createDataFrame([("aab" * 1000,)], "w string"), "w", vocab).first()["parts"]
    assert long == ["aab"] * 1000


TREATY = (
    "CHAPTER 3\nTrade Remedies\n\nArticle 1 \nScope and Purpose\n1. First clause.\n2. Second clause. 3. Third"
    "\n Rule 4.2\nNotices\nOnly text.\nArticle 5: \nLast\n1. End."
)


def test_treaty_text(spark):
    df = spark.createDataFrame([("x", "part", TREATY), ("x", "loose", "one \n \ntwo")], "a string, t string, b string")
    rows = G.text_clauses(df, "a", "t", "b").collect()
    got = {(r.chapter, r.article, r.clauseno): r.text for r in rows if r.t == "part"}
    assert got[("Trade Remedies", "Scope and Purpose", 1)] == "First clause."
    assert got[("Trade Remedies", "Scope and Purpose", 2)] == "Second clause"
    assert got[("Trade Remedies", "Scope and Purpose", 3)] == "Third"
    assert ("Trade Remedies", "Notices", 1) in got and ("Trade Remedies", "Last", 1) in got
    assert [(r.chapter, r.text) for r in rows if r.t == "loose"] == [(None, "one"), (None, "two")]


def test_national_chain(spark):
    df = spark.createDataFrame([("x", "part", TREATY), ("y", "part", TREATY)], "fta string, title string, body string")
    rows = national_clauses(df, "fta", "title", "body").collect()
    assert {r.fta for r in rows} == {"x"}  # copies go
    assert all(not r.text.startswith("1.") for r in rows) and {r.chapter for r in rows} == {"Trade Remedies"}


def test_clauses_that_differ_in_a_number_stay(spark):
    text = "CHAPTER 3\nTrade Remedies\n\nArticle 1 \nScope and Purpose\n1. The quota for item 12 applies.\n2. The quota for item 45 applies.\n"
    rows = national_clauses(spark.createDataFrame([("x", "part", text)], "fta string, title string, body string"), "fta", "title", "body").collect()
    assert sorted(r.clauseno for r in rows) == [1, 2]


def test_inline_clauses_and_lists(spark):
    df = spark.createDataFrame([("1. One. 2. Two. 3. Three.",)], "text string")
    assert [(r.clauseno, r.text) for r in treaty_clauses(df).collect()] == [(1, "One"), (2, "Two"), (3, "Three")]
    lists = spark.createDataFrame([("Parties shall: (a) act (b) rest",), ("none",)], "t string")
    assert run(lists, G.distribute_list("t")) == [["Parties shall:  act", "Parties shall:  rest"], ["none"]]


def test_middle_matches_slicing(spark):
    for n in range(0, 9):
        arr = list(range(n))
        df = spark.createDataFrame([(arr,)], "a array<int>")
        for k in (2, 3, 4):
            lo, hi = n // 2 - k // 2, n // 2 + k // 2
            assert run(df, G.middle("a", k))[0] == arr[lo : hi + 1], (n, k)


def test_fixed_lists():
    assert L.PUNCTUATION == string.punctuation and len(L.STOP_WORDS) == len(set(L.STOP_WORDS))
