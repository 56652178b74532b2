"""The one-pass rules against one search per rule."""

import random

import pytest
from pyspark.sql import functions as F

from assayline.functions import brand
from assayline.functions.rules import RuleIndex, fold, rule_matches
from assayline.functions.text import spans, word_pattern

PIECES = [
    "kill", "Kill", "KILLS", "gun control", "gun  control", "gun", "control", "C++", "c", "++", "-x", "x", "x-x", "x x x",
    "straße", "STRASSE", "İstanbul", "ı", "I", "i", "K", "k", "Été", "été", "σ",
    "Σ", "ς", "a_b", "a", "_", "$5", "5", "١", "é", "\U0001f600", ".", ", ", "\n", " ", "'", "don't",
]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    joined = ["".join(draw.choice([p, p + " ", p]) for p in draw.choices(PIECES, k=draw.randint(0, 12))) for _ in range(400)]
    return [*joined, "", None, "kill", "x x x x x", "kill-kill kill"]


def test_one_pass_finds_what_one_search_per_rule_finds(spark, texts):
    values = [p for p in PIECES if p.strip()] + ["x x", "kill gun", "C++ x", "i̇", "."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    one = df.select("id", rule_matches(F.col("text"), values).alias("m"))
    got = {r.id: r.m for r in one.collect()}
    each = df.select("id", *[spans(F.col("text"), word_pattern(v)).alias(f"v{i}") for i, v in enumerate(values)])
    for r in each.collect():
        if texts[r.id] is None:
            assert got[r.id] is None
            continue
        want = [(i, s.start, s.end) for i in range(len(values)) for s in r[f"v{i}"]]
        assert [tuple(m) for m in got[r.id]] == want, texts[r.id]


def test_thousands_of_rules_cost_one_look_up_a_word():
    index = RuleIndex([f"w{i}" for i in range(5000)] + ["w7 w8", "w7 w9"])
    assert index.matches("W7 w8, w7.w9 w70x") == [(7, 0, 2), (7, 7, 9), (8, 3, 5), (9, 10, 12), (5000, 0, 5)]
    looked = []
    index.by_word = type("Counted", (dict,), {"get": lambda self, k, d=(): looked.append(k) or dict.get(self, k, d)})(index.by_word)
    index.matches("one two w3")
    assert looked == ["one", "two", "w3"]


def test_folding_keeps_positions():
    for text in PIECES:
        assert len(fold(text)) == len(text)


def test_counts_and_violations_follow_the_matches(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    terms = ("kill", "gun control")
    rows = df.select(
        "text", brand.count_word_rules(F.col("text"), brand.TERM, terms).alias("n"),
        brand.violations_by_rule(F.col("text"), brand.TERM, terms).alias("by_rule"),
        rule_matches(F.col("text"), ("x", *terms)).alias("m"),
    ).withColumn("v", brand.word_violations(F.col("m"), brand.TERM, terms, 1)).collect()
    assert any(r.n for r in rows)
    for r in rows:
        if r.text is None:
            assert r.n is None and r.v is None
            continue
        assert r.n == sum(x.hits for x in r.by_rule) == len(r.v)
        assert [r.text[x.start : x.end].lower() for x in r.v] == [x.value for x in r.v]
