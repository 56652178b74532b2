"""Work on batches: functions that may fail, and runs of rows that bound the memory of the others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20  # what an Arrow function unpacks of a batch at a time


def halved(score: Callable[[Sequence], Sequence], items: Sequence) -> list[tuple[Any, str | None]]:
    """(result, error) of every item; a batch that fails is split until the failing items are alone.

    A batch fails when ``score`` raises or gives another number of results. With f failing
    items among n about 2 f log2(n) batches are scored once more, so a few bad rows cost little.
    """
    if not len(items):
        return []
    try:
        results = score(items)
        if len(results) != len(items):
            raise ValueError(f"{len(results)} results for {len(items)} items")
        return [(result, None) for result in results]
    except Exception as failure:
        if len(items) == 1:
            return [(None, str(failure) or type(failure).__name__)]
        middle = len(items) // 2
        return halved(score, items[:middle]) + halved(score, items[middle:])


def bounded(sizes: Sequence[int], most: int, most_items: int) -> list[tuple[int, int]]:
    """Consecutive (start, end) ranges within a total size and a number of items, one at least."""
    out, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start >= most_items):
            out.append((start, i))
            start, total = i, 0
        total += size
    if len(sizes) > start:
        out.append((start, len(sizes)))
    return out


def row_bytes(rows: pa.Array) -> np.ndarray:
    """Size of every row of a column of texts, or of lists of them at any depth."""
    if pa.types.is_list(rows.type) or pa.types.is_large_list(rows.type):
        ends = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        upto = np.concatenate([[0], np.cumsum(row_bytes(rows.flatten()) + 8)])
        return np.diff(upto[np.concatenate([[0], ends])])
    if pa.types.is_string(rows.type) or pa.types.is_large_string(rows.type):
        return pc.binary_length(rows).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(rows), 8, np.int64)


def in_runs(function: Callable[..., pa.Array], *columns: pa.Array, most: int = RUN_BYTES) -> pa.Array:
    """``function`` over runs of rows of at most ``most`` bytes (one row at least), put together again.

    Spark cuts its batches by rows and bytes as the session says. What a function makes of a batch, Python
    objects or codes of every word, is many times that size, and of a run it is bounded.
    """
    runs = bounded(sum(row_bytes(c) for c in columns).tolist(), most, len(columns[0]))
    if len(runs) < 2:
        return function(*columns)
    return pa.concat_arrays([function(*[c.slice(a, b - a) for c in columns]) for a, b in runs])
