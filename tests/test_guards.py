"""The rules on pairs whose verdicts are known."""

import pytest
from pyspark.sql import functions as F

from palisade.functions import text as T
from palisade.operators import guards as G

REJECTED = [
    ("numeric", "Book 120 chairs for the hall", "Book 210 chairs for the hall"),
    ("numeric", "Scale it by 3,5 now", "Scale it by 5,3 now"),
    ("unit", "How heavy is 5 kg of rice", "How heavy is 5 lbs of rice"),
    ("temporal", "Who leads the company today", "Who leads the company tomorrow"),
    ("negation", "plants that cats may chew at home", "plants that cats may not chew at home"),
    ("antonym", "keep the porch light on overnight", "keep the porch light off overnight"),
    ("entity", "Who governs the town of Lugano", "Who governs the town of Lucerne"),
    ("substitution", "draw a tall green ladder", "draw a tall green lantern"),
    ("scope", "give me a summary of this report", "give me a tutorial of this report"),
    ("direction", "convert gallons to litres or pints", "convert litres to gallons or pints"),
    ("sub-span", "How do I sort an array", "How do I sort an array without extra memory"),
    ("lexical-divergence", "plan cheap family trip through Lisbon by train", "list seven famous painters born near lakes"),
]
ACCEPTED = [
    ("numeric", "A hall of 1,200 seats", "A hall of 1200 seats"),
    ("unit", "90 f in c", "What is 90 degrees Fahrenheit in Celsius?"),
    ("temporal", "the current branch in git", "the active branch in git merges now"),
    ("negation", "which cheese melts well today", "reasons why trains are never late in winter"),
    ("antonym", "run this before deploy", "run this prior to deploy"),
    ("entity", "Explain the Application Programming Interface to me", "Explain the API to me"),
    ("substitution", "draw a tall green ladder", "draw a tall geren ladders"),
    ("scope", "an overview of this", "an overview and an example of this"),
    ("direction", "how do I move from A1 to B1", "how do I move from A1 to B1"),
    ("sub-span", "sort an array", "I am on Ubuntu, sort an array"),
    ("lexical-divergence", "short one", "other text"),
]


def verdicts(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (_, a, b) in enumerate(pairs)], "i int, a string, b string")
    read = df.select("i", T.read(F.col("a")).alias("q"), T.read(F.col("b")).alias("c"))
    chain = {g.name: g for g in G.standard()}
    both = {n: G.either_way(g, F.col("q"), F.col("c")).alias(n) for n, g in chain.items()}
    return {r["i"]: r.asDict() for r in read.select("i", *both.values()).collect()}


def test_known_verdicts(spark):
    got = verdicts(spark, REJECTED)
    assert [(p, got[i][p[0]]) for i, p in enumerate(REJECTED) if not got[i][p[0]]] == []
    got = verdicts(spark, ACCEPTED)
    assert [(p, got[i][p[0]]) for i, p in enumerate(ACCEPTED) if got[i][p[0]]] == []


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("cat", "cut", False), ("mak", "make", True), ("raed", "read", True), ("armenia", "argentina", False), ("color", "colour", True), ("walk", "walking", False), ("paint", "painting", True), ("12345", "12354", True), ("1234", "1243", False), ("recieve", "receive", True), ("house", "houses", True), ("a", "b", False)],
)
def test_same_word(spark, a, b, same):
    row = spark.range(1).select(T.same_word(F.lit(a), F.lit(b)).alias("ab"), T.same_word(F.lit(b), F.lit(a)).alias("ba")).first()
    assert (row.ab, row.ba) == (same, same)


@pytest.mark.parametrize(
    ("text", "found"),
    [("Rank Oslo vs. Bergen", ["oslo", "bergen"]), ("River: Loire. Show me its length.", ["loire"]), ("Read XML. Explain it with a drawing", ["xml"]), ("I met Dr. Who in Paris", ["dr", "who", "paris"]), ("", []), (None, [])],
)
def test_names(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.names(F.col("t")).alias("n")).first().n == found


def test_nulls_and_chain_order(spark):
    df = spark.createDataFrame([(None, "x"), ("", ""), ("Convert 1 kg today", "Convert 2 lbs tomorrow")], "a string, b string")
    got = [r.g for r in df.select(G.first_rejection(G.standard(), T.read(F.col("a")), T.read(F.col("b"))).alias("g")).collect()]
    assert got == [None, None, "numeric"]


def test_response_rule_abstains_without_a_response(spark):
    df = spark.createDataFrame([("capital city of spain now", "capital city of italy now", "The capital of Italy is Rome")], "a string, b string, r string")
    read = df.select(T.read(F.col("a")).alias("q"), T.read(F.col("b")).alias("c"), "r")
    rule = G.answer_anchor()
    row = read.select(rule.reason(F.col("q"), F.col("c")).alias("silent"), rule.reason(F.col("q"), F.col("c"), F.col("r")).alias("said")).first()
    assert (row.silent, row.said) == (None, "answer-anchor")
