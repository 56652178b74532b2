"""Numbers with an optional currency sign, percent sign or magnitude word."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import empty_array, let
from .text import spans_of, split_sentences, unicode_pattern

# The number grammar (groups: sign, currency, digits, percent, unit).
NUMBER_PATTERN = (
    r"(?:(?:approximately|about|around|roughly|nearly|over|under)\s+)?"
    r"([+-])?"
    r"(\$|€|£)?"
    r"([\d,]+(?:\.\d+)?)"
    r"(\s*%?)?"
    r"(?:\s*(billion|million|thousand|bps|basis points|percent))?"
)
# Magnitude words and their factors.
MAGNITUDES = {"billion": 1e9, "million": 1e6, "thousand": 1e3}

_PATTERN = unicode_pattern(NUMBER_PATTERN, ignore_case=True)
_HAS_DIGIT = r"\p{Nd}"

NUMBER_TYPE = "struct<value:double,unit:string,match:string,start:int,end:int,negative:boolean>"


def _other_digits() -> tuple[str, str]:
    """Every non-ASCII decimal digit and the ASCII digit of the same value."""
    found = [chr(c) for c in range(0x80, sys.maxunicode + 1) if chr(c).isdecimal()]
    return "".join(found), "".join(str(int(c)) for c in found)


_OTHER_DIGITS, _ASCII_DIGITS = _other_digits()


def _groups(match: Column) -> Column:
    """The parts of one match, each cut once."""
    return F.struct(
        *[
            F.regexp_extract(match, _PATTERN, i).alias(name)
            for i, name in enumerate(("sign", "currency", "digits", "percent", "unit"), start=1)
        ]
    )


def _value(parts: Column) -> Column:
    digits = F.replace(parts["digits"], F.lit(","), F.lit(""))
    # Only a text that has them pays for the long translation table.
    ascii_digits = F.when(
        digits.rlike(r"[^0-9.]"), F.translate(digits, _OTHER_DIGITS, _ASCII_DIGITS)
    ).otherwise(digits)
    factor = F.lit(1.0)
    for word, size in MAGNITUDES.items():
        factor = F.when(F.lower(parts["unit"]) == word, F.lit(size)).otherwise(factor)
    return ascii_digits.try_cast("double") * factor


def _unit(parts: Column) -> Column:
    # A blank before the magnitude word is taken by the percent group, so the unit of
    # "81.8 billion" is empty although the factor applies.
    return (
        F.when(parts["currency"] != "", parts["currency"])
        .when(parts["percent"] != "", F.regexp_extract(parts["percent"], "(%?)$", 1))
        .otherwise(parts["unit"])
    )


def extract_numbers(text: Column) -> Column:
    """All numbers of ``text`` in order, as an array of :data:`NUMBER_TYPE`."""

    def describe(match: Column, span: Column) -> Column:
        return let(
            _groups(match),
            lambda parts: F.struct(
                _value(parts).alias("value"),
                _unit(parts).alias("unit"),
                match.alias("match"),
                span["start"].alias("start"),
                span["end"].alias("end"),
                (parts["sign"] == "-").alias("negative"),
            ),
        )

    def from_matches(parts: Column) -> Column:
        matches = parts["matches"]
        return F.filter(
            F.zip_with(matches, spans_of(matches, parts["gaps"]), describe), lambda n: n["value"].isNotNull()
        )

    # the text is matched once for the numbers and once for what lies between them
    found = let(
        let(
            text,
            lambda t: F.struct(
                F.regexp_extract_all(t, F.lit(_PATTERN), F.lit(0)).alias("matches"), F.split(t, _PATTERN).alias("gaps")
            ),
        ),
        from_matches,
    )
    return F.when(text.rlike(_HAS_DIGIT), found).otherwise(empty_array(NUMBER_TYPE))


CLAIM_TYPE = (
    "struct<sentence:int,text:string,type:string,value:double,unit:string,"
    "start:int,end:int,negative:boolean>"
)


def claims_of(sentences: Column) -> Column:
    """Per sentence one textual claim, then one numerical claim per number, in order."""

    def of_sentence(s: Column, position: Column) -> Column:
        textual = F.struct(
            position.alias("sentence"),
            s.alias("text"),
            F.lit("textual").alias("type"),
            F.lit(None).cast("double").alias("value"),
            F.lit(None).cast("string").alias("unit"),
            F.lit(None).cast("int").alias("start"),
            F.lit(None).cast("int").alias("end"),
            F.lit(None).cast("boolean").alias("negative"),
        )
        numerical = F.transform(
            extract_numbers(s),
            lambda n: F.struct(
                position.alias("sentence"),
                s.alias("text"),
                F.lit("numerical").alias("type"),
                n["value"].alias("value"),
                n["unit"].alias("unit"),
                n["start"].alias("start"),
                n["end"].alias("end"),
                n["negative"].alias("negative"),
            ),
        )
        return F.concat(F.array(textual), numerical)

    return F.flatten(F.transform(sentences, of_sentence))


def extract_claims(text: Column) -> Column:
    """Claims of a text; spans are relative to the sentence of the claim."""
    return claims_of(split_sentences(text))


def first_close_number(value: Column, numbers: Column, tolerance: float, signed: bool = False,
                       negative: Column | None = None) -> Column:
    """First number, in text order, within the relative tolerance; null if none is.

    Zero matches only zero. The sign is ignored unless ``signed`` is set.
    """
    def signed_value(v: Column, is_negative: Column) -> Column:
        return F.when(is_negative, -v).otherwise(v)

    def close(n: Column) -> Column:
        theirs = signed_value(n["value"], n["negative"]) if signed else n["value"]
        ours = signed_value(value, negative) if signed and negative is not None else value
        return F.when(theirs == 0, ours == 0).otherwise(
            F.try_divide(F.abs(ours - theirs), F.abs(theirs)) <= F.lit(tolerance)
        )

    return F.get(F.filter(numbers, close), F.lit(0))
