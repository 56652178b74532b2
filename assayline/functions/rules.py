"""Whole-word rules found in one pass over a text, however many rules there are.

A rule is a literal with a word boundary at both ends, letter case apart. The rules are looked
up by what a match has to begin with: the whole first word, where a rule begins with a word
character, or the character after the end of a word, where it does not. Every word of a text
costs one dictionary look-up; only rules whose first word is there are compared with what
follows, and no pattern is searched per rule.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import in_runs
from .expr import let
from .words import code_points, strings, words_of

MATCH_TYPE = "array<struct<rule:int,start:int,end:int>>"

_WORD = re.compile(r"\w+")


def _folded(char: str) -> str:
    """The character that stands for all that a case-insensitive match treats as equal."""
    upper = char.upper()
    upper = upper if len(upper) == 1 else char
    lower = upper.lower()
    return lower[0] if len(lower) == 1 or upper == "İ" else upper


_FOLDS: dict[int, str] = {}
_FOLD_POINTS: list[np.ndarray] = []


def _fold_table() -> dict[int, str]:
    """The characters that folding changes, ASCII capitals included; made when first needed."""
    if not _FOLDS:
        for c in range(0x1E944):
            if not 0xD800 <= c < 0xE000 and (folded := _folded(chr(c))) != chr(c):
                _FOLDS[c] = folded
    return _FOLDS


def fold(text: str) -> str:
    """Fold letter case, one character for one, so that positions stay."""
    return text.lower() if text.isascii() else text.translate(_fold_table())


def folded(texts: Sequence[str]) -> list[str]:
    """All texts folded, by one pass over their code points."""
    whole = "\n".join(texts)
    if whole.isascii():
        whole = whole.lower()
    else:
        if not _FOLD_POINTS:
            table = np.arange(0x110000, dtype="<u4")
            for point, to in _fold_table().items():
                table[point] = ord(to)
            _FOLD_POINTS.append(table)
        whole = _FOLD_POINTS[0][code_points(whole)].tobytes().decode("utf-32-le")
    ends = np.cumsum([len(t) + 1 for t in texts]).tolist()
    return [whole[end - len(t) - 1 : end - 1] for t, end in zip(texts, ends, strict=True)]


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


class RuleIndex:
    """Rules by the word, or the character behind a word, with which a match begins."""

    def __init__(self, values: Sequence[str]):
        self.rules = [fold(v) for v in values]
        self.by_word: dict[str, list[int]] = {}
        self.by_char: dict[str, list[int]] = {}
        self.empty = [i for i, v in enumerate(self.rules) if not v]
        for i, value in enumerate(self.rules):
            if not value:
                continue
            if _is_word(value[0]):
                self.by_word.setdefault(_WORD.match(value).group(), []).append(i)
            else:
                self.by_char.setdefault(value[0], []).append(i)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, start, end) by rule, then position; matches of one rule do not overlap."""
        text = fold(text)
        if not self.by_char and not self.empty and self.by_word.keys().isdisjoint(_WORD.findall(text)):
            return []
        found: list[tuple[int, int, int]] = []
        free: dict[int, int] = {}
        for word in _WORD.finditer(text):
            for i in self.by_word.get(word.group(), ()):
                self._compare(text, i, word.start(), free, found)
            for i in self.by_char.get(text[word.end() : word.end() + 1], ()):
                self._compare(text, i, word.end(), free, found)
            # an empty rule is met at either edge of a word
            found.extend((i, edge, edge) for i in self.empty for edge in word.span())
        found.sort()
        return found

    def matches_of(self, texts: Sequence[str | None]) -> list[list[tuple[int, int, int]]]:
        """The matches of every text; only words that begin a rule are looked at one by one."""
        if self.empty:
            return [self.matches(t) if t else [] for t in texts]
        texts = folded([t or "" for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        words, free = words_of(texts), [{} for _ in texts]
        begun = [self.by_word.get(w, ()) for w in words.different.to_pylist()]
        met = np.flatnonzero(np.array([bool(b) for b in begun], bool)[words.codes])
        rules_at = [(met, words.start, [begun[c] for c in words.codes[met]])]
        if self.by_char:
            met = np.flatnonzero(np.isin(words.after, [ord(c) for c in self.by_char]))
            rules_at.append((met, words.end, [self.by_char[chr(c)] for c in words.after[met]]))
        for met, at, begun_there in rules_at:
            for n, start, some in zip(words.owner[met].tolist(), at[met].tolist(), begun_there, strict=True):
                for i in some:
                    self._compare(texts[n], i, start, free[n], found[n])
        for matches in found:
            matches.sort()
        return found

    def _compare(self, text: str, i: int, start: int, free: dict[int, int], found: list) -> None:
        rule = self.rules[i]
        end = start + len(rule)
        if start < free.get(i, 0) or not text.startswith(rule, start):
            return
        if _is_word(rule[-1]) != (end < len(text) and _is_word(text[end])):
            free[i] = end
            found.append((i, start, end))


def rule_matches(text: Column, values: Sequence[str]) -> Column:
    """array<struct<rule, start, end>>: all matches in a text, by rule and position.

    ``rule`` counts the values from 0, offsets are characters. The index is built once per task.
    """
    if not values:
        return F.when(text.isNotNull(), F.array().cast(MATCH_TYPE))
    values = tuple(values)
    built: list[RuleIndex] = []

    def find_in(texts: pa.Array) -> pa.Array:
        found = built[0].matches_of(strings(texts))
        flat = np.array([m for matches in found for m in matches], np.int32).reshape(-1, 3)
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        structs = pa.StructArray.from_arrays(
            [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["rule", "start", "end"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets), structs, mask=texts.is_null())

    def find(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(RuleIndex(values))
        return in_runs(find_in, texts)

    # computed in a projection of its own, however often the result is used
    return F.arrow_udf(find, MATCH_TYPE).asNondeterministic()(text)


def count_by_rule(matches: Column) -> Column:
    """array<struct<rule, hits>> of the rules that matched, in rule order."""
    return let(
        matches,
        lambda m: F.transform(
            F.array_distinct(F.transform(m, lambda x: x["rule"])),
            lambda rule: F.struct(
                rule.alias("rule"), F.size(F.filter(m, lambda x: x["rule"] == rule)).cast("long").alias("hits")
            ),
        ),
    )
