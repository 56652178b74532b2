"""Words of many texts at once, found by a table over code points instead of a search per text.

A word is a run of letters, numbers and underscores (``\\w+`` of Python, ``[\\p{L}\\p{N}_]+`` of the JVM).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_TABLE: dict[str, np.ndarray] = {}


def _word_table() -> np.ndarray:
    """Whether a code point belongs to a word; made when first needed."""
    if "word" not in _TABLE:
        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = ord(" ")
        table = np.zeros(len(points), bool)
        for run in re.finditer(r"\w+", points.tobytes().decode("utf-32-le")):
            table[run.start() : run.end()] = True
        _TABLE["word"] = table
    return _TABLE["word"]


def strings(texts: pa.Array) -> list[str | None]:
    """The texts as Python strings; bytes that are not UTF-8 become replacement characters, as in the JVM."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [b if b is None else b.decode("utf-8", "replace") for b in texts.view(pa.binary()).to_pylist()]


class Words(NamedTuple):
    """All words of some texts, in order."""

    owner: np.ndarray  # the text of a word
    start: np.ndarray  # its first character, from the start of its text
    end: np.ndarray
    after: np.ndarray  # the code point behind it, a line break behind the last of a text
    codes: np.ndarray  # its place among the different words
    different: pa.Array


def code_points(whole: str) -> np.ndarray:
    if whole.isascii():
        return np.frombuffer(whole.encode("ascii"), np.uint8)
    return np.frombuffer(whole.encode("utf-32-le"), "<u4")


def words_of(texts: Sequence[str]) -> Words:
    """Words as they stand in the texts, letter case included."""
    whole = "\n".join(texts) + "\n"
    points = code_points(whole)
    inside = _word_table()[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.concatenate([[0], edges]) if inside[0] else edges
    start, end = edges[::2], edges[1::2]
    if whole.isascii():
        letters, sizes = points[inside], end - start
    else:
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        letters = np.frombuffer(whole.encode(), np.uint8)[np.repeat(inside, width)]
        upto = np.concatenate([[0], np.cumsum(width)])
        sizes = upto[end] - upto[start]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    encoded = words.dictionary_encode()
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    owner = np.searchsorted(first, start, "right") - 1
    return Words(
        owner, start - first[owner], end - first[owner], points[end],
        encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary,
    )


def word_sets(*columns: pa.Array) -> list[pa.Array]:
    """The columns with each text replaced by the list of its distinct words, letter case apart.

    A column holds texts or lists of texts; a missing text has no words. Words are numbers, which mean
    the same in all columns of a call and nothing beyond it.
    """
    flat = [c.flatten() if pa.types.is_list(c.type) else c for c in columns]
    words = words_of([t.lower() if t else "" for f in flat for t in strings(f)])
    n, span = sum(map(len, flat)), len(words.different) + 1
    keys = np.sort(words.owner * span + words.codes)  # much faster than np.unique on keys nearly in order
    owner, codes = np.divmod(keys[np.diff(keys, prepend=-1) > 0], span)
    upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    out, at = [], 0
    for column, texts in zip(columns, flat, strict=True):
        sets = pa.ListArray.from_arrays(pa.array(upto[at : at + len(texts) + 1]), pa.array(codes))
        at += len(texts)
        if texts is not column:
            per_row = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
            sets = pa.ListArray.from_arrays(rows, sets, mask=column.is_null())
        out.append(sets)
    return out
