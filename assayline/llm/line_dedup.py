"""Fuzzy line deduplication: MinHash over character shingles, one line per component is kept.

Lines are split at ``\\n`` and compared without the white space around them. A line's set
holds its distinct strings of ``GRAM`` bytes; a shorter line is one string, so it is alike with
equal lines only. ``BANDS`` bands of ``ROWS`` minhashes make the table keys: at similarity 0.8 a
pair is missed with probability (1 - 0.8**ROWS)**BANDS, about 0.2 %, at 0.9 with 3e-6, and unlike
lines rarely share a key however many there are. Candidates are confirmed by exact Jaccard
similarity of the full sets, and components come from :mod:`assayline.llm.linking`. Of each
component the first occurrence stays (smallest ``doc_id``, then a hash of the text, then line
number); all others, exact and fuzzy, are removed.

Blank lines are always kept. Null texts stay null and empty ones empty. A null ``doc_id`` sorts
first. Rows that repeat both id and text are one document: both keep the same lines. All
columns of the input are kept, and the number of rows never changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.hashing import Ranges, mix
from assayline.llm.linking import link
from assayline.llm.shared import chunks, cut, row_key

GRAM = 8
BANDS = 12
ROWS = 4
PERCENT = 80
BLOCK_GRAMS = 1 << 16


def eligible(text: bytes) -> list[tuple[int, bytes]]:
    """Numbers and stripped contents of the lines that are not blank."""
    lines = ((i, line.strip()) for i, line in enumerate(text.split(b"\n")))
    return [(i, x) for i, x in lines if x]


def grams(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ``GRAM``-byte strings of all lines as integers, and how many each line has.

    A line of fewer bytes is one string, filled up with zeros and its length.
    """
    at = np.cumsum([0, *map(len, lines)])
    sizes = np.diff(at)
    data = np.frombuffer(b"".join(lines) + bytes(GRAM), np.uint8)
    every = np.ndarray((at[-1],), np.uint64, data, strides=(1,))
    counts = np.maximum(sizes - GRAM + 1, 1)
    first = np.cumsum(counts) - counts
    place = np.repeat(at[:-1] - first, counts) + np.arange(counts.sum())
    values = every[place]
    short = np.flatnonzero(sizes < GRAM)
    bits = (8 * sizes[short]).astype(np.uint64)
    values[first[short]] &= (np.uint64(1) << bits) - np.uint64(1)
    values[first[short]] |= sizes[short].astype(np.uint64) << np.uint64(56)
    return values, counts


def line_nodes(lines: list[bytes], state: dict) -> np.ndarray:
    """A 64-bit hash of every line."""
    data = np.frombuffer(b"".join(lines), np.uint8)
    at = np.cumsum([0, *map(len, lines)])
    return Ranges(data, state)(at[:-1], at[1:]).view(np.int64)


def band_keys(lines: list[bytes], bands: int, rows: int) -> np.ndarray:
    """Table keys, one row per line, from minhashes of all strings of all lines.

    Lines are taken in blocks whose values stay in a processor's cache.
    """
    out = np.zeros((len(lines), bands), np.uint64)
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)).astype(np.uint32)
    start = size = 0
    for end in range(1, len(lines) + 1):
        size += len(lines[end - 1])
        if end < len(lines) and size < BLOCK_GRAMS:
            continue
        values, counts = grams(lines[start:end])
        values *= np.uint64(0x9E3779B97F4A7C15)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xBF58476D1CE4E5B9)
        small = (values >> np.uint64(32)).astype(np.uint32)
        hashed = np.empty_like(small)
        first = np.cumsum(counts) - counts
        own = out[start:end]
        for i in range(bands):
            for j in range(rows):
                k = 2 * (i * rows + j)
                np.bitwise_xor(small, seeds[k], out=hashed)
                np.multiply(hashed, seeds[k + 1] | np.uint32(1), out=hashed)
                own[:, i] = mix(own[:, i] + np.minimum.reduceat(hashed, first))
            own[:, i] = mix(own[:, i] + np.uint64(i + 1))
        start, size = end, 0
    return out


def line_set(line: bytes) -> np.ndarray:
    """The sorted distinct strings of a line."""
    if len(line) < GRAM:
        return grams([line])[0]
    values = np.sort(np.ndarray((len(line) - GRAM + 1,), np.uint64, line, strides=(1,)))
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _lines(batches: Iterator[pa.RecordBatch], state: dict) -> Iterator[tuple]:
    """Chunks of rows with their lines: the rows, (number, line) by row, all lines, their nodes."""
    for batch, texts in chunks(batches, "text"):
        found = [eligible(t) for t in texts]
        lines = [x for doc in found for _, x in doc]
        if lines:
            yield batch, found, lines, line_nodes(lines, state)


def _sketched(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``key, node`` of the lines that are new in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        seen: set[int] = set()
        for _, _, lines, nodes in _lines(batches, state):
            new: list[int] = []
            for i, node in enumerate(nodes.tolist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            if new:
                keys = band_keys([lines[i] for i in new], bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(nodes[new], bands))], ["key", "node"]
                )

    return docs.select("text").mapInArrow(run, "key long, node long")


def _placed(docs: DataFrame) -> DataFrame:
    """``d, h, lines, nodes``: which lines a row has."""
    d, h = row_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch, found, _, nodes in _lines(batches, state):
            at = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("h"),
                 pa.array([[i for i, _ in doc] for doc in found], pa.list_(pa.int32())),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(nodes))],
                ["d", "h", "lines", "nodes"],
            )

    return docs.select(d.alias("d"), h.alias("h"), "text").mapInArrow(
        run, "d long, h long, lines array<int>, nodes array<long>"
    )


def line_components(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """``d, h, line, component, first`` of all lines that repeat: ``first`` is the one that stays.

    Keys go straight into the shuffle that groups them; which lines a row has is a pass of its own.
    """
    places = cut(_placed(docs)).select("d", "h", F.explode(F.arrays_zip("lines", "nodes")).alias("x")).select(
        "d", "h", F.col("x.lines").alias("line"), F.col("x.nodes").alias("node")
    )
    d, h = row_key()
    texts = docs.select(d.alias("d"), h.alias("h"), "text")

    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = (
            nodes.join(places, "node").groupBy("node").agg(F.min(F.struct("d", "h", "line")).alias("at"))
            .groupBy("at.d", "at.h").agg(F.collect_list("at.line").alias("lines"), F.collect_list("node").alias("nodes"))
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = []
                for text, numbers in zip(batch.column("text"), batch.column("lines").to_pylist(), strict=True):
                    split = (text.as_py() or "").encode().split(b"\n")
                    lines += [split[i].strip() for i in numbers]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("nodes").flatten(), pa.array(lines, pa.binary()),
                     pa.array([len(line_set(x)) for x in lines], pa.int64())],
                    ["node", "payload", "size"],
                )

        return texts.join(wanted, ["d", "h"]).select("text", "lines", "nodes").mapInArrow(
            run, "node long, payload binary, size long"
        )

    labels = link(_sketched(docs, bands, rows), fetch, line_set, percent)
    grouped = places.join(labels, "node", "left").select(
        "d", "h", "line", F.coalesce("component", "node").alias("component")
    )
    firsts = grouped.groupBy("component").agg(
        F.min(F.struct("d", "h", "line")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("component", "first")
    return grouped.join(firsts, "component")


def _shortened(docs: DataFrame, bands: int, rows: int, percent: int) -> DataFrame:
    """``row, text, removed``: every input row, its text without repeated lines, and their number."""
    places = line_components(docs, bands, rows, percent)
    dropped = places.where(F.struct("d", "h", "line") != F.col("first")).groupBy("d", "h").agg(
        F.collect_set("line").alias("dropped")
    )
    d, h = row_key()
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), d.alias("d"), h.alias("h")
    )
    kept = F.array_join(
        F.transform(
            F.filter(
                F.transform(F.split("row.text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                lambda x: ~F.array_contains("dropped", x["i"]),
            ),
            lambda x: x["x"],
        ),
        "\n",
    )
    return keyed.join(dropped, ["d", "h"], "left").select(
        "row", F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(kept).alias("text"),
        F.coalesce(F.size("dropped"), F.lit(0)).alias("removed"),
    )


def dedup_lines(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """The input with its columns, repeated lines removed from ``text``, plus ``n_lines_removed``.

    An input column of that name is replaced.
    """
    return _shortened(docs, bands, rows, percent).select(
        *(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "n_lines_removed"),
        F.col("removed").alias("n_lines_removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The input with its columns, whatever their names; ``n_chars`` follows a changed ``text``."""
    size = F.when(F.col("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    changed = {"text": F.col("text"), "n_chars": size}
    return _shortened(docs, BANDS, ROWS, PERCENT).select(
        *(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns)
    )
