"""Links between similar sets that share table keys, and their connected components.

``entries`` holds ``key, node`` rows. Every key has a pivot, its node that meets the most
others over all of its keys, so the nodes of a group of near copies agree on few pivots. Nodes
that share a key share its pivot: a group holds a pivot and all nodes that meet it, every set
travels once per pivot, and links are found inside a group without listing its pairs:

* shingles that most of the group share are counted for all pairs at once by a matrix product;
* shingles of a single member cannot be common, and those of few members bound what is missing,
  so most pairs are decided by bounds; only the others are intersected in full;
* pairs that are connected by then are left out.

A group of more than ``GROUP_ITEMS`` shingles is dealt out as pairs of blocks, so a task holds
two blocks at most. All links go into one union-find: every partition of a million links
reduces them to a spanning forest, and large-star and small-star rounds join the forests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.shared import cut

MAX_ROUNDS = 60
GROUP_ITEMS = 1_000_000
WIDE = 8  # a shingle is common if one in so many members has it
ROW_BLOCK = 512
PART_LINKS = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the smallest of each component, with that smallest node."""
    names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        if np.array_equal(low, np.maximum(root[x], root[y])):
            break
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(further := root[root], root):  # halve the paths
            root = further
    child = root != np.arange(len(names))
    return names[child], names[root[child]]


def _forests(links: DataFrame) -> DataFrame:
    """``a, b`` of a spanning forest of each partition, b being the root of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(x) for x, _ in held) > PART_LINKS:
                a, b = forest(*(np.concatenate([own, *found]) for own, found in zip((a, b), zip(*held), strict=True)))
                held = []
        if held:
            a, b = forest(*(np.concatenate([own, *found]) for own, found in zip((a, b), zip(*held), strict=True)))
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour."""
    both = links.select("a", "b").union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    return (
        both.where("b > a").join(low.hint("merge"), "a")
        .select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them (a > b in links)."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    side = links.join(low.hint("merge"), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return low.toDF("a", "b").union(side).distinct()


def components(links: DataFrame, part_links: int = PART_LINKS) -> DataFrame:
    """``node, component`` of every node in ``a, b`` links: the smallest node reachable.

    Up to ``part_links`` links are one partition, whose forest is the answer. Beyond that the
    forests of the partitions shrink to stars by alternating rounds, none of which adds a link.
    """
    links = links.select("a", "b").where("a <> b")
    parts = math.ceil(links.count() / part_links)
    if parts <= 1:
        stars = cut(_forests(links.coalesce(1)))
    else:
        stars = cut(_forests(links.repartition(parts, F.least("a", "b"))))
        for _ in range(MAX_ROUNDS):
            before = _digest(stars)
            stars = cut(_small_star(_large_star(stars)))
            if _digest(stars) == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = stars.select(F.col("b").alias("node")).distinct()
    return stars.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))


def _digest(links: DataFrame) -> tuple:
    """One row that tells two tables of links apart."""
    code = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(code), F.sum(code.cast("decimal(38,0)"))).first())


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")  # a merge of two sorted sets
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


def alike_in_group(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all members with a similarity of ``percent`` / 100 or more.

    Links between members that earlier links connect are left out.
    """
    n = len(sets)
    if n == 2:  # most groups are
        return [(0, 1)] if _alike(*sets, percent) else []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    _, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    code = code.astype(np.int32)
    common = counts >= max(2, n // WIDE)
    column = (np.cumsum(common) - 1).astype(np.int32)
    at = common[code]
    rest = np.bincount(owner[(counts[code] > 1) & ~at], minlength=n)
    width = int(common.sum())
    step = max(1, min(width, (1 << 22) // n))
    label = np.arange(n)
    out = []
    for start in range(0, n, ROW_BLOCK):
        end = min(n, start + ROW_BLOCK)
        shared = np.zeros((end - start, n), np.float32)
        for low in range(0, width, step):
            held = np.zeros((n, min(step, width - low)), np.float32)
            own = np.flatnonzero(at & (column[code] >= low) & (column[code] < low + step))
            held[owner[own], column[code[own]] - low] = 1
            shared += held[start:end] @ held.T
        shared = shared.astype(np.float64)
        total = percent * (sizes[start:end, None] + sizes[None, :])
        possible = (100 + percent) * (shared + np.minimum(rest[start:end, None], rest[None, :])) >= total
        certain = (100 + percent) * shared >= total
        for i in range(start, end):
            for sure in (True, False):
                row = certain[i - start] if sure else possible[i - start]
                for j in np.flatnonzero(row & (label != label[i])).tolist():
                    if j <= i or label[j] == label[i]:
                        continue
                    if not sure and not _alike(sets[i], sets[j], percent):
                        continue
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _judged(members: DataFrame, as_set: Callable[[bytes], np.ndarray], percent: int) -> DataFrame:
    """``a, b`` links found in the groups of ``p, i, j, node, payload`` rows."""

    def linked(nodes: list[int], payloads: list[bytes]) -> pa.RecordBatch:
        found = alike_in_group([as_set(x) for x in payloads], percent) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[k] for k, _ in found], pa.int64()), pa.array([nodes[k] for _, k in found], pa.int64())],
            ["a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, payloads = None, [], []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("p", "i", "j")), strict=True))
            for k, name in enumerate(names):
                if name != group:
                    yield linked(nodes, payloads)
                    group, nodes, payloads = name, [], []
                nodes.append(batch.column("node")[k].as_py())
                payloads.append(batch.column("payload")[k].as_py())
        yield linked(nodes, payloads)

    return members.mapInArrow(run, "a long, b long")


def link(
    entries: DataFrame, fetch: Callable[[DataFrame], DataFrame], as_set: Callable[[bytes], np.ndarray],
    percent: int, group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """``node, component`` of all nodes that share a key with another.

    ``fetch`` turns a table of distinct ``node`` into ``node, payload, size``, ``as_set`` a payload
    into its sorted distinct shingles, of which there are ``size``.
    """
    group = Window.partitionBy("key")
    shared = cut(
        entries.select(
            "key", "node", F.min("node").over(group).alias("low"), F.max("node").over(group).alias("high"),
            F.count(F.lit(1)).over(group).alias("n"),
        ).where("low < high").select("key", "node", "n")
    )
    payloads = cut(fetch(shared.select("node").distinct()))
    met = shared.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = shared.join(met.hint("merge"), "node").join(payloads.select("node", "size").hint("merge"), "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("met", "node")).alias("top")).select(
        "key", F.col("top.node").alias("p")
    )
    stars = cut(ranked.join(pivots.hint("merge"), "key").select("p", "node", "size").distinct())
    blocks = stars.groupBy("p").agg(F.ceil(F.sum("size") / group_items).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = (
        stars.join(blocks.hint("merge"), "p").select("p", "node", "blocks", block.alias("x"), other.alias("y"))
        .where("blocks = 1 or x <> y")
        .select("p", "node", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    )
    links = cut(
        _judged(
            members.join(payloads.select("node", "payload").hint("merge"), "node")
            .repartition("p", "i", "j").sortWithinPartitions("p", "i", "j", "node"),
            as_set, percent,
        )
    )
    joined = components(links)
    return payloads.select("node").join(joined.hint("merge"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
