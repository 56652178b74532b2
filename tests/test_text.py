import random
import re

import pytest
from pyspark.sql import functions as F

from assayline.functions import numbers, pii, text
from assayline.functions.rounding import format_fixed, round_exact

SAMPLES = [
    "", "   ", "No. Only the second of these two is long enough.",
    "Boats left at dawn. Not one came back! Where did they go? Nobody on the shore knew.",
    "0123456789. Abcdefghijk.", "One two three four.  Next sentence here.",
    "Ends with tab.\t\tThen More text follows.", "no capital. after the stop, so one sentence",
    "Élan vital à côté. Été indien arrive. Zut alors mes amis.", "\x1cstripped text here\x1f",
    "😀 smile here please. Then a second one 😀 ok.",
]


def kept(t):
    parts = re.split(r"(?<=[.!?])\s+(?=[A-Z])", t.strip())
    return [p.strip() for p in parts if len(p.strip()) > 10]


@pytest.mark.parametrize("t", SAMPLES)
def test_sentences_and_words_follow_python(one, t):
    assert one(text.split_sentences, t) == kept(t)
    assert one(text.words, t) == t.split()


def test_sentence_length_is_strict(one):
    assert one(text.split_sentences, "abcdefghi.") == []
    assert one(text.split_sentences, "abcdefghij.") == ["abcdefghij."]


@pytest.mark.parametrize(
    "t", ["", "aXbXX", "XaX", "é1 22 😀333", "no match", "X" * 7]
)
def test_spans_are_character_offsets(one, t):
    got = one(lambda c: text.spans(c, r"X|\d+"), t)
    assert [(s["start"], s["end"]) for s in got] == [m.span() for m in re.finditer(r"X|\d+", t)]


def test_word_pattern_has_unicode_boundaries(one):
    count = lambda c: F.regexp_count(c, F.lit(text.word_pattern("re")))
    assert one(count, "re Re, rée ré re_ x-re") == 3
    assert one(lambda c: F.regexp_count(c, F.lit(text.word_pattern("c++ x"))), "c++ x c++ xy") == 1


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(7)
    values = [0.00015, 0.12345, 0.125, 0.03125, 1.00005, 0.99995, 2.5e-5, 7.5e-5, 0.0, 1.0]
    values += [rng.random() for _ in range(500)]
    values += [k / 15 for k in range(16)] + [k / 20000 for k in range(1, 400, 2)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(
        "x",
        round_exact("x", 4).alias("named"),
        round_exact(F.col("x") + F.lit(0.0), 4).alias("bound"),
        round_exact("x", 2).alias("two"),
        format_fixed("x", 2).alias("text"),
    )
    for row in df.collect():
        assert row["named"] == round(row["x"], 4)
        assert row["bound"] == round(row["x"], 4)
        assert row["two"] == round(row["x"], 2)
        assert row["text"].lstrip("-") == f"{row['x']:.2f}".lstrip("-")
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),)], "x double")
    assert [str(r[0]) for r in odd.select(round_exact("x", 4)).collect()] == ["nan", "inf"]


@pytest.mark.parametrize(
    "t, expected",
    [
        ("Revenue was $81.8 billion.", [(81.8e9, "$")]),
        ("About 81.8 billion people.", [(81.8e9, "")]),
        ("It holds 5billion cells.", [(5e9, "billion")]),
        ("Growth was 14% this year.", [(14.0, "%")]),
        ("A rise of 25 bps and 3bps.", [(25.0, ""), (3.0, "bps")]),
        ("Lone , commas ,, and 1,234.5 here", [(1234.5, "")]),
        ("From -5 to +7 degrees", [(5.0, ""), (7.0, "")]),
        ("Paid €2 million today", [(2e6, "€")]),
        ("Digits ٣ and १२", [(3.0, ""), (12.0, "")]),
        ("none", []),
    ],
)
def test_numbers(one, t, expected):
    got = one(numbers.extract_numbers, t)
    assert [(n["value"], n["unit"]) for n in got] == expected
    for n in got:
        assert t[n["start"] : n["end"]] == n["match"]


def test_claims_keep_sentence_order_and_relative_spans(one):
    claims = one(numbers.extract_claims, "Revenue was $81.8 billion. EPS came in at $1.26.")
    assert [c["type"] for c in claims] == ["textual", "numerical", "textual", "numerical"]
    last = claims[-1]
    assert last["text"][last["start"] : last["end"]] == "$1.26"
    assert one(numbers.extract_claims, "") == []


@pytest.mark.parametrize(
    "t, kinds",
    [
        ("Write to m.ostrander@example.org before noon.", ["email"]),
        ("The desk answers (415) 867-5309 until six.", ["phone_us"]),
        ("SSN: 123-45-6789", ["ssn"]),
        ("Card: 4111 1111 1111 1111", ["credit_card"]),
        ("Host 999.999.999.999 is down", ["ip_address"]),
        ("She was Born On: 1/2/1990, dob 3-4-88", ["date_of_birth", "date_of_birth"]),
        ("Prices fell by 3% last Friday.", []),
        ("x@y.a|b", ["email"]),
    ],
)
def test_pii(one, t, kinds):
    found = one(pii.detect_pii, t)
    assert [f["type"] for f in found] == kinds
    for f in found:
        assert t[f["start"] : f["end"]] == f["match"]
    assert [(p["type"], p["match"]) for p in one(pii.pii_matches, t)] == [
        (f["type"], f["match"]) for f in found
    ]


def test_phone_match_loses_its_opening_bracket(one):
    assert one(pii.pii_matches, "Dial (415) 867-5309.")[0]["match"] == "415) 867-5309"
    assert one(pii.redact_pii, "Dial (415) 867-5309.") == "Dial ([phone_us]."
