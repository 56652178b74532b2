"""Cosine similarity of embedding columns, as array operations over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexical import MATCH_TYPE, _lengths, _list_of_structs, _once, _starts

_BLOCK = 1024  # rows of one side compared at a time: bounds the similarity block


def _matrix(rows: pa.Array) -> np.ndarray:
    """All vectors of a list-of-vectors column, stacked."""
    vectors = rows.flatten()
    if not len(vectors):
        return np.zeros((0, 1))
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), -1)


def _safe_divide(dot: np.ndarray, squares: np.ndarray) -> np.ndarray:
    norms = np.sqrt(squares)
    return np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def _cosines(sentences: pa.Array, source: pa.Array) -> pa.Array:
    per_row = _lengths(sentences)
    mine = _matrix(sentences)
    cosine = np.zeros(len(mine))
    if len(mine):
        # Rows without a sentence may have no source vector at all; they are not looked at.
        used = source.filter(pa.array(per_row > 0))
        theirs = used.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        theirs = np.repeat(theirs.reshape(len(used), -1), per_row[per_row > 0], axis=0)
        squares = (mine * mine).sum(axis=1) * (theirs * theirs).sum(axis=1)
        cosine = _safe_divide((mine * theirs).sum(axis=1), squares)
    return pa.ListArray.from_arrays(pa.array(_starts(per_row).astype(np.int32)), pa.array(cosine))


def vector_cosines(sentences: Column, source: Column) -> Column:
    """Cosine of each sentence vector of a row with the vector of the whole source."""

    def cosines(sentences: pa.Array, source: pa.Array) -> pa.Array:
        return _cosines(sentences, source)

    return _once(cosines, T.ArrayType(T.DoubleType()))(sentences, source)


def best_vector(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine of each row of one matrix with the rows of another, and the first to reach it."""
    my_squares, their_squares = (mine * mine).sum(axis=1), (theirs * theirs).sum(axis=1)
    best = np.full(len(mine), -np.inf)
    position = np.zeros(len(mine), dtype=np.int32)
    for a in range(0, len(mine), _BLOCK):
        b = min(a + _BLOCK, len(mine))
        for c in range(0, len(theirs), _BLOCK):
            d = min(c + _BLOCK, len(theirs))
            similarity = _safe_divide(
                mine[a:b] @ theirs[c:d].T, np.outer(my_squares[a:b], their_squares[c:d])
            )
            top = similarity.argmax(axis=1)
            value = similarity[np.arange(b - a), top]
            better = value > best[a:b]
            best[a:b][better] = value[better]
            position[a:b][better] = c + top[better]
    return best, position


def _best_vectors(sentences: pa.Array, evidence: pa.Array) -> pa.Array:
    per_row, ev_per_row = _lengths(sentences), _lengths(evidence)
    mine, theirs = _matrix(sentences), _matrix(evidence)
    first, ev_first = _starts(per_row), _starts(ev_per_row)
    best = np.full(len(mine), -np.inf)
    position = np.zeros(len(mine), dtype=np.int32)
    for row in range(len(per_row)):
        own = slice(first[row], first[row + 1])
        best[own], position[own] = best_vector(mine[own], theirs[ev_first[row] : ev_first[row + 1]])
    return _list_of_structs(
        per_row, sentences, {"similarity": pa.array(best), "position": pa.array(position)}
    )


def best_vector_matches(sentences: Column, evidence: Column) -> Column:
    """Best evidence vector for each sentence vector of a row; the first one wins a tie."""

    def match(sentences: pa.Array, evidence: pa.Array) -> pa.Array:
        return _best_vectors(sentences, evidence)

    return _once(match, MATCH_TYPE)(sentences, evidence)


def stacked(parts: list, n: int) -> np.ndarray:
    """The vectors of ``n`` texts as one matrix; it is an error if they differ in size."""
    rows = [np.asarray(v, dtype=np.float32) for part in parts for v in part]
    if len(rows) != n:
        raise ValueError(f"{len(rows)} vectors for {n} texts")
    if len({v.shape for v in rows}) > 1 or rows[0].ndim != 1:
        raise ValueError("vectors of different sizes")
    return np.stack(rows).astype(np.float64)


def cosines_with(mine: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Cosine of each row with one vector."""
    return _safe_divide((mine * whole).sum(axis=1), (mine * mine).sum(axis=1) * (whole * whole).sum())
