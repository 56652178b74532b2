"""Word-overlap stand-ins for the model scores.

They are used when no model columns are given, and their rows say ``method = 'lexical'``.
A text is its set of distinct words; similarity is the cosine of two such sets, and
entailment is the share of a sentence's words that the source also holds.

The comparisons of one row (every sentence against the source, or against each source sentence)
run as array operations over Arrow batches: set functions inside SQL lambdas rebuild a hash set
per pair and were several times slower. The evaluators hand over whole texts, whose words are cut
for many rows at once (see ``functions.words``); word sets that a table already has are taken as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_runs
from .words import word_sets

GROUNDING_TYPE = T.ArrayType(
    T.StructType().add("containment", T.DoubleType()).add("cosine", T.DoubleType())
)
MATCH_TYPE = T.ArrayType(
    T.StructType().add("similarity", T.DoubleType()).add("position", T.IntegerType())
)

# Budget of one block of evidence in words, and in cells of its dense form (items by words).
_BLOCK_WORDS = 16384
_BLOCK_CELLS = 1 << 23
_BLOCK_SENTENCES = 256
# Rows with at most this many (sentence, evidence) pairs are compared together, in runs of
# at most so many pairs; larger rows are compared one by one as dense blocks.
_SMALL_ROW_PAIRS = 2048
_SMALL_RUN_PAIRS = 32768


def token_set(text: Column) -> Column:
    return F.array_distinct(
        F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    )


def token_sets_of(texts: Sequence[str]) -> list[list[str]]:
    """Word sets of configured texts."""
    return [list(dict.fromkeys(re.findall(r"\w+", t.lower()))) for t in texts]


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Start of each list in the flattened values, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)])


def _codes(*token_arrays: pa.Array) -> list[np.ndarray]:
    """Integer codes of the words, shared by all given arrays."""
    filled = [a for a in token_arrays if len(a)]
    if not filled:
        return [np.zeros(0, dtype=np.int64) for _ in token_arrays]
    if all(pa.types.is_integer(a.type) for a in filled):
        return [a.to_numpy(zero_copy_only=False).astype(np.int64) for a in token_arrays]
    encoded = pa.concat_arrays(filled).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(codes, np.cumsum([len(a) for a in token_arrays])[:-1])


def _nested(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(sentences per row, words per sentence, words) of a list-of-lists column."""
    sentences = rows.flatten()
    return _lengths(rows), _lengths(sentences), sentences.flatten()


def _list_of_structs(lengths: np.ndarray, rows: pa.Array, fields: dict[str, pa.Array]) -> pa.Array:
    offsets = _starts(lengths).astype(np.int32)
    mask = rows.is_null()
    values = pa.StructArray.from_arrays(list(fields.values()), list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def _grounding(sentences: pa.Array, source: pa.Array) -> pa.Array:
    per_row, per_sentence, words = _nested(sentences)
    source_sizes = _lengths(source)
    codes, source_codes = _codes(words, source.flatten())
    row_of_sentence = np.repeat(np.arange(len(per_row)), per_row)
    sentence_of_word = np.repeat(np.arange(len(per_sentence)), per_sentence)
    span = max(codes.max(initial=0), source_codes.max(initial=0)) + 1
    keys = row_of_sentence[sentence_of_word] * span + codes
    source_keys = np.repeat(np.arange(len(source_sizes)), source_sizes) * span + source_codes
    shared = np.bincount(
        sentence_of_word[np.isin(keys, source_keys)], minlength=len(per_sentence)
    ).astype(np.float64)
    norms = np.sqrt((per_sentence * source_sizes[row_of_sentence]).astype(np.float64))
    zero = np.zeros(len(per_sentence))
    containment = np.divide(shared, per_sentence, out=zero.copy(), where=per_sentence > 0)
    cosine = np.divide(shared, norms, out=zero.copy(), where=norms > 0)
    return _list_of_structs(
        per_row, sentences, {"containment": pa.array(containment), "cosine": pa.array(cosine)}
    )


def _once(function: Callable, result: T.DataType) -> Callable[..., Column]:
    """An Arrow UDF whose result is computed in a projection of its own.

    Expressions over a deterministic Python UDF are all inlined into their consumers, however
    often these use them: a score that is read thirty times would be computed thirty times.
    Declaring the function non-deterministic keeps the projections apart.
    """
    return F.arrow_udf(function, result).asNondeterministic()


def sentence_grounding(sentences: Column, source: Column) -> Column:
    """Containment in, and cosine with, the whole source, for each sentence of a row."""

    def grounding(sentences: pa.Array, source: pa.Array) -> pa.Array:
        return in_runs(_grounding, sentences, source)

    return _once(grounding, GROUNDING_TYPE)(sentences, source)


def text_grounding(sentences: Column, source: Column) -> Column:
    """:func:`sentence_grounding` of an array of sentences in a source text."""

    def of_texts(sentences: pa.Array, source: pa.Array) -> pa.Array:
        return _grounding(*word_sets(sentences, source))

    def grounding(sentences: pa.Array, source: pa.Array) -> pa.Array:
        return in_runs(of_texts, sentences, source)

    return _once(grounding, GROUNDING_TYPE)(sentences, source)


def _blocks(sizes: np.ndarray):
    """Consecutive ranges of evidence, each within the budget (one item at least)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        words = total + size
        if i > start and (words > _BLOCK_WORDS or words * (i + 1 - start) > _BLOCK_CELLS):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _dense(codes: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Zero/one rows over a sorted vocabulary; words outside it are left out."""
    at = np.searchsorted(vocabulary, codes)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == codes
    out = np.zeros((len(sizes), len(vocabulary)), dtype=np.float32)
    out[np.repeat(np.arange(len(sizes)), sizes)[known], at[known]] = 1.0
    return out


def _best(codes, sizes, evidence_codes, evidence_sizes):
    """Best cosine and first position reaching it, per sentence of one row."""
    n = len(sizes)
    best, position = np.full(n, -1.0), np.zeros(n, dtype=np.int32)
    starts, ev_starts = _starts(sizes), _starts(evidence_sizes)
    for lo, hi in _blocks(evidence_sizes):
        block_codes = evidence_codes[ev_starts[lo] : ev_starts[hi]]
        block_sizes = evidence_sizes[lo:hi]
        vocabulary = np.unique(block_codes)
        dense = _dense(block_codes, block_sizes, vocabulary) if len(vocabulary) else None
        for a in range(0, n, _BLOCK_SENTENCES):
            b = min(a + _BLOCK_SENTENCES, n)
            if dense is None:
                similarity = np.zeros((b - a, hi - lo))
            else:
                mine = _dense(codes[starts[a] : starts[b]], sizes[a:b], vocabulary)
                shared = (mine @ dense.T).astype(np.float64)
                norms = np.sqrt(np.outer(sizes[a:b], block_sizes).astype(np.float64))
                similarity = np.divide(
                    shared, norms, out=np.zeros_like(shared), where=norms > 0
                )
            top = similarity.argmax(axis=1)
            value = similarity[np.arange(b - a), top]
            better = value > best[a:b]
            best[a:b][better] = value[better]
            position[a:b][better] = lo + top[better]
    return best, position


def _matches_of_small_rows(rows, codes, sizes, first, ev_codes, ev_sizes, ev_first, best, position):
    """All rows of ``rows`` (consecutive) at once, as one join on (row, word).

    Pairs of a sentence and a piece of evidence that share no word never come up; a sentence
    without any pair keeps similarity 0 at position 0.
    """
    start, stop = rows
    lo, hi, ev_lo, ev_hi = first[start], first[stop], ev_first[start], ev_first[stop]
    at, ev_at = _starts(sizes), _starts(ev_sizes)
    codes, ev_codes = codes[at[lo] : at[hi]], ev_codes[ev_at[ev_lo] : ev_at[ev_hi]]
    if not len(codes) or not len(ev_codes):
        return
    row_of = np.repeat(np.arange(start, stop), np.diff(first[start : stop + 1]))
    ev_row_of = np.repeat(np.arange(start, stop), np.diff(ev_first[start : stop + 1]))
    sentence = np.repeat(np.arange(hi - lo), sizes[lo:hi])
    evidence = np.repeat(np.arange(ev_hi - ev_lo), ev_sizes[ev_lo:ev_hi])
    width = max(codes.max(), ev_codes.max()) + 1
    keys, ev_keys = row_of[sentence] * width + codes, ev_row_of[evidence] * width + ev_codes
    order = np.argsort(ev_keys, kind="stable")
    left = np.searchsorted(ev_keys[order], keys, "left")
    hits = np.searchsorted(ev_keys[order], keys, "right") - left
    within = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
    met = evidence[order][np.repeat(left, hits) + within]
    pairs, shared = np.unique(np.repeat(sentence, hits) * (ev_hi - ev_lo) + met, return_counts=True)
    if not len(pairs):
        return
    s, e = np.divmod(pairs, ev_hi - ev_lo)
    similarity = shared / np.sqrt((sizes[lo + s] * ev_sizes[ev_lo + e]).astype(np.float64))
    ranked = np.lexsort((e, -similarity, s))
    found, at_rank = np.unique(s[ranked], return_index=True)
    top = ranked[at_rank]
    best[lo + found] = similarity[top]
    position[lo + found] = (ev_lo + e[top] - ev_first[row_of[found]]).astype(np.int32)


def _row_groups(pairs_per_row: np.ndarray):
    """(start, stop, small): runs of rows with few pairs to compare, or one large row."""
    start, total = 0, 0
    for row, pairs in enumerate(pairs_per_row):
        large = pairs > _SMALL_ROW_PAIRS
        if row > start and (large or total + pairs > _SMALL_RUN_PAIRS):
            yield start, row, True
            start, total = row, 0
        if large:
            yield row, row + 1, False
            start, total = row + 1, 0
        else:
            total += pairs
    if start < len(pairs_per_row):
        yield start, len(pairs_per_row), True


def _matches(sentences: pa.Array, evidence: pa.Array, facts: list[list]) -> pa.Array:
    per_row, per_sentence, words = _nested(sentences)
    ev_per_row, ev_per_sentence, ev_words = _nested(evidence)
    fact_sizes = np.array([len(f) for f in facts], dtype=np.int64)
    fact_words = pa.array([w for f in facts for w in f], words.type)
    codes, ev_codes, fact_codes = _codes(words, ev_words, fact_words)
    first, ev_first = _starts(per_row), _starts(ev_per_row)
    at, ev_at = _starts(per_sentence), _starts(ev_per_sentence)
    best = np.zeros(len(per_sentence))
    position = np.zeros(len(per_sentence), dtype=np.int32)
    pairs = per_row * (ev_per_row if not facts else _SMALL_ROW_PAIRS + 1)
    for start, stop, small in _row_groups(pairs):
        if small:
            _matches_of_small_rows(
                (start, stop), codes, per_sentence, first, ev_codes, ev_per_sentence, ev_first,
                best, position,
            )
            continue
        lo, hi, ev_lo, ev_hi = first[start], first[stop], ev_first[start], ev_first[stop]
        best[lo:hi], position[lo:hi] = _best(
            codes[at[lo] : at[hi]],
            per_sentence[lo:hi],
            np.concatenate([ev_codes[ev_at[ev_lo] : ev_at[ev_hi]], fact_codes]),
            np.concatenate([ev_per_sentence[ev_lo:ev_hi], fact_sizes]),
        )
    return _list_of_structs(
        per_row, sentences, {"similarity": pa.array(best), "position": pa.array(position)}
    )


def best_matches(sentences: Column, evidence: Column, facts: Sequence[str] = ()) -> Column:
    """Most similar piece of evidence for each sentence of a row; the first one wins a tie.

    ``facts`` are configured texts that count as evidence after the row's own. They travel
    with the function, so keep them to configuration size; larger sets belong in a table
    (see ``operators.knowledge``).
    """
    fact_sets = token_sets_of(facts)

    def match(sentences: pa.Array, evidence: pa.Array) -> pa.Array:
        return in_runs(lambda s, e: _matches(s, e, fact_sets), sentences, evidence)

    return _once(match, MATCH_TYPE)(sentences, evidence)


def text_matches(sentences: Column, evidence: Column, facts: Sequence[str] = ()) -> Column:
    """:func:`best_matches` of an array of sentences among an array of texts."""
    facts = list(facts)

    def of_texts(sentences: pa.Array, evidence: pa.Array) -> pa.Array:
        own, theirs, common = word_sets(sentences, evidence, pa.array(facts, pa.string()))
        return _matches(own, theirs, common.to_pylist())

    def match(sentences: pa.Array, evidence: pa.Array) -> pa.Array:
        return in_runs(of_texts, sentences, evidence)

    return _once(match, MATCH_TYPE)(sentences, evidence)
