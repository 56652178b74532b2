"""Sentence, word and span functions over one text column. All JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _regex_class(chars: str) -> str:
    """Latin-1 members one by one (Java keeps those in one bit set), the rest as ranges."""
    parts = [f"\\x{ord(c):02x}" for c in chars if ord(c) < 256]
    others = [ord(c) for c in chars if ord(c) >= 256]
    while others:
        run = 1
        while run < len(others) and others[run] == others[0] + run:
            run += 1
        parts.append(f"\\x{{{others[0]:x}}}-\\x{{{others[run - 1]:x}}}")
        others = others[run:]
    return "[" + "".join(parts) + "]"


_SPACE_CLASS = _regex_class(WHITESPACE)
_WORD_CLASS = r"[\p{L}\p{N}_]"
_WORD_EDGE = rf"(?:(?<={_WORD_CLASS})(?!{_WORD_CLASS})|(?<!{_WORD_CLASS})(?={_WORD_CLASS}))"

# Sentence boundary and the length a kept sentence must exceed.
SENTENCE_BOUNDARY = r"(?<=[.!?])\s+(?=[A-Z])"
MIN_SENTENCE_CHARS = 10


def unicode_pattern(pattern: str, ignore_case: bool = False) -> str:
    r"""Make ``\b``, ``\d`` and ``\s`` mean the Unicode classes, whatever the JDK default."""
    meanings = {r"\b": _WORD_EDGE, r"\d": r"\p{Nd}", r"\s": _SPACE_CLASS}
    spelled_out = re.sub(r"\\[bds]", lambda m: meanings[m.group(0)], pattern)
    return ("(?iu)" if ignore_case else "") + spelled_out


def word_pattern(word: str) -> str:
    """Whole-word, case-insensitive pattern of a literal word or phrase."""
    literal = "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in word)
    return unicode_pattern(rf"\b{literal}\b", ignore_case=True)


_BOUNDARY = unicode_pattern(SENTENCE_BOUNDARY)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def raw_sentences(text: Column) -> Column:
    """Pieces between sentence boundaries, short ones included."""
    return F.split(strip(text), _BOUNDARY)


def split_sentences(text: Column) -> Column:
    """Stripped sentences longer than ten characters."""
    return kept_sentences(raw_sentences(text))


def kept_sentences(pieces: Column) -> Column:
    """Those of the raw sentences that are long enough.

    They are stripped as they are: a boundary takes all white space between its neighbours, and the text's
    own ends are stripped before.
    """
    return F.filter(pieces, lambda s: F.length(s) > MIN_SENTENCE_CHARS)


def words(text: Column) -> Column:
    """White-space separated words; an empty array for a blank text."""
    return F.filter(F.split(strip(text), f"{_SPACE_CLASS}+"), lambda w: w != "")


def spans(text: Column, pattern: str | Column) -> Column:
    """(start, end) character offsets of each non-overlapping match."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    return spans_of(F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex))


def spans_of(matches: Column, gaps: Column) -> Column:
    """(start, end) character offsets of matches between the gaps that are left of the text."""
    # zip_with pads the shorter side: there is one more gap than there are matches
    lengths = F.zip_with(
        matches,
        gaps,
        lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")
    )

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + piece["gap"]
        finish = begin + piece["size"]
        return F.struct(
            finish.alias("at"),
            F.array_append(
                acc["out"], F.struct(begin.alias("start"), finish.alias("end"))
            ).alias("out"),
        )

    return F.aggregate(
        F.filter(lengths, lambda piece: piece["size"].isNotNull()),
        start,
        step,
        lambda acc: acc["out"],
    )


def excerpt(text: Column, chars: int = 80) -> Column:
    """Display form used in flag messages: a cut text, the ellipsis always appended."""
    return F.concat(F.substring(text, 1, chars), F.lit("..."))
