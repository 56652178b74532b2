"""Near-duplicate documents: MinHash with tensored banding, candidates verified on full sets.

A document's set holds its distinct shingles of ``size`` words, lower-cased in A-Z; a text
of fewer words is one shingle. ``HALVES`` small collections of ``ROWS`` minhashes each are
computed, and every pair of collections forms a table key: 12 collections of 2 give 66 tables
of 4 rows from 24 hashes instead of 264. Two documents are candidates when two collections
agree. At similarity 0.8 a collection agrees with probability 0.64 and a pair is missed with
probability 1e-4, at 0.9 with 2e-8.

Candidates are confirmed on the full sets in integers: 100 * intersection >= 80 * union
(shingles as 64-bit hashes). Components are found by :mod:`assayline.llm.linking`.

Null texts and texts without words have an empty set and are linked with nothing. Equal
texts share their work. Rows that repeat an id are kept; a null id takes part like any other
but ranks last, so it represents a group only if all ids there are null. Ties do not arise:
the smallest id of a component is kept, on every row that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm import hashing
from assayline.llm.linking import link
from assayline.llm.shared import NO_ID, chunks, cut, row_key

HALVES = 12
ROWS = 2
SEED = 7


def sets(texts: list[bytes], size: int, state: dict) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = hashing.word_hashes([t.lower() for t in texts], state)
    return [np.unique(hashing.shingles(words[a:b], size)) for a, b in zip(at[:-1], at[1:], strict=True)]


def table_keys(groups: list[np.ndarray], halves: int, rows: int) -> np.ndarray:
    """Keys of all pairs of collections, one row per non-empty set."""
    flat = np.concatenate(groups)
    starts = np.cumsum([0, *(len(g) for g in groups[:-1])])
    seeds = hashing.mix(np.arange(1, 2 * halves * rows + 1, dtype=np.uint64) + np.uint64(SEED << 32))
    half = np.zeros((halves, len(groups)), np.uint64)
    for i in range(halves):
        for j in range(rows):
            k = 2 * (i * rows + j)
            low = np.minimum.reduceat((flat ^ seeds[k]) * (seeds[k + 1] | np.uint64(1)), starts)
            half[i] = hashing.mix(half[i] + low)
    return np.stack(
        [hashing.mix(half[i] * np.uint64(0x9E3779B97F4A7C15) + half[j] + np.uint64(i * halves + j))
         for i, j in combinations(range(halves), 2)], axis=1,
    )


def sketched(docs: DataFrame, size: int, halves: int, rows: int) -> DataFrame:
    """``doc_id, node, n_shingles, keys``: keys only for the first of equal texts in a task."""
    source = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        seen: set[int] = set()
        for batch, texts in chunks(batches, "text"):
            nodes = batch.column("node").to_pylist()
            groups = sets(texts, size, state)
            fresh = []
            for i, (node, group) in enumerate(zip(nodes, groups, strict=True)):
                if len(group) and node not in seen:
                    seen.add(node)
                    fresh.append(i)
            keys: list = [None] * len(nodes)
            if fresh:
                found = table_keys([groups[i] for i in fresh], halves, rows).view(np.int64)
                for i, row in zip(fresh, found, strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"),
                 pa.array([len(g) for g in groups], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "node", "n_shingles", "keys"],
            )

    return source.mapInArrow(run, "doc_id long, node long, n_shingles long, keys array<long>")


def groups(
    docs: DataFrame, size: int = 5, percent: int = 80, halves: int = HALVES, rows: int = ROWS
) -> DataFrame:
    """``doc_id, node, n_shingles, group`` of every row; the group is null for an empty set."""
    table = cut(sketched(docs, size, halves, rows))
    entries = table.select("node", F.explode("keys").alias("key"))
    d, h = row_key()
    texts = docs.select(d.alias("d"), h.alias("node"), "text")

    def fetch(nodes: DataFrame) -> DataFrame:
        holders = table.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("d")).join(nodes, "node")
        held = texts.join(holders, ["d", "node"]).dropDuplicates(["d", "node"]).select("node", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}
            for batch, found in chunks(batches, "text"):
                own = sets(found, size, state)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([s.tobytes() for s in own], pa.binary()),
                     pa.array([len(s) for s in own], pa.int64())],
                    ["node", "payload", "size"],
                )

        return held.mapInArrow(run, "node long, payload binary, size long")

    labels = link(entries, fetch, lambda payload: np.frombuffer(payload, np.uint64), percent)
    return table.select("doc_id", "node", "n_shingles").join(labels, "node", "left").select(
        "doc_id", "node", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("group"),
    )


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, halves: int = HALVES, rows: int = ROWS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    grouped = groups(docs, size, percent, halves, rows)
    lowest = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("low"))
    joined = grouped.join(lowest, "group", "left").withColumn(
        "component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    )
    return joined.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with its columns: the smallest id, then hash of the text.

    Rows without words are in no group and stay.
    """
    grouped = groups(docs, size, percent).where("group is not null").select(
        "group", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("node").alias("h")
    )
    chosen = grouped.groupBy("group").agg(F.min(F.struct("d", "h")).alias("first")).select("first.*")
    grouped = grouped.select("d", "h").distinct().withColumn("grouped", F.lit(True))
    decided = grouped.join(chosen.withColumn("chosen", F.lit(True)), ["d", "h"], "left")
    d, h = row_key()
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), d.alias("d"), h.alias("h")
    ).join(decided, ["d", "h"], "left")
    # a chosen row that is repeated stays once; the join has brought its repeats together
    turn = F.row_number().over(Window.partitionBy("d", "h").orderBy("h"))
    return keyed.withColumn("turn", turn).where(
        F.col("grouped").isNull() | (F.col("chosen").isNotNull() & (F.col("turn") == 1))
    ).select("row.*")
