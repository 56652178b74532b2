"""Exact top-k search by inner product: branch and bound over a ball tree in every shard.

Candidates are dealt to shards by a hash of their row. A shard builds a ball tree: a node has a
centre and a radius, and q.c + |q| * radius is at least the inner product of q with any vector
below it. Queries pass through in blocks. For a block nodes leave a heap in the order of
their bound; a node is opened for those queries only whose kth score so far does not exceed
it, and a leaf is scored for them by one exact matrix product. The kth score is shared twice:
within a block every leaf raises it for the leaves to come, and across shards a first wave
searches each query in one shard only, so the second wave enters all other shards with a
kth score that already prunes. Bounds have a margin for rounding, scores are integers, ties go to
the smaller id, and nothing that could tie is pruned: the result is that of a full scan.

Queries are a stated set of rows. They go to the shards, of which there are one per ``SHARD_ROWS``
vectors but enough for all cores; a task holds one shard and a block of queries.

Vectors that are null or hold null or non-finite components take no part. Vectors of different
sizes have no product: a query meets those of its own size. A null id is no query and ranks
after all others as a candidate. Repeated ids are rows of their own; a row never meets
itself. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.shared import cut
from assayline.llm.vectors import integers, matrix

K = 5
SHARD_ROWS = 131_072
LEAST_ROWS = 2_048
LEAF = 256
BLOCK = 256
NO_ID = 2**63 - 1
LOWEST = -(2**63)
EXACT = 2**53


class BallTree:
    """A tree whose nodes are balls; leaves hold at most ``leaf`` vectors, or equal ones, by id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((rows, ids))
        plain = vectors.astype(float)
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.place: list[np.ndarray | None] = []
        self.child: list[tuple[int, int]] = []
        root = self._node(plain, order)
        waiting = [(root, order)] if len(vectors) else []
        while waiting:
            node, own = waiting.pop()
            if len(own) <= leaf or self.radius[node] == 0:
                self.place[node] = own
                continue
            # split halfway along the line between two far vectors
            points = plain[own]
            far = points[((points - points[0]) ** 2).sum(axis=1).argmax()]
            other = points[((points - far) ** 2).sum(axis=1).argmax()]
            along = points @ (other - far)
            half = np.zeros(len(own), bool)
            half[np.argsort(along, kind="stable")[: len(own) // 2]] = True
            parts = own[half], own[~half]
            self.child[node] = tuple(self._node(plain, part) for part in parts)
            waiting.extend(zip(self.child[node], parts, strict=True))
        self.vectors, self.ids, self.rows = vectors, ids, rows
        self.most = int(np.abs(vectors).max(initial=0))

    def _node(self, plain: np.ndarray, own: np.ndarray) -> int:
        centre = plain[own].mean(axis=0) if len(own) else np.zeros(plain.shape[1])
        radius = np.sqrt(((plain[own] - centre) ** 2).sum(axis=1)).max(initial=0)
        self.centre.append(centre)
        self.radius.append(radius * (1 + 1e-9))
        self.place.append(None)
        self.child.append(())
        return len(self.centre) - 1

    def bound(self, node: int, plain: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """An upper bound of the product of each query with what lies below a node."""
        top = plain @ self.centre[node] + norm * self.radius[node]
        return top + 1e-9 * (np.abs(top) + norm * np.linalg.norm(self.centre[node])) + 1e-6

    def scores(self, queries: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Exact products; in floating point only where all partial sums are exact."""
        vectors = self.vectors[own]
        if int(np.abs(queries).max(initial=0)) * self.most * max(1, queries.shape[1]) < EXACT:
            return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
        return queries @ vectors.T

    def search(self, queries: np.ndarray, rows: np.ndarray, kth: np.ndarray, k: int) -> list[np.ndarray]:
        """(query, score, id) of the best ``k`` of each query that reach its ``kth`` score; raises ``kth``."""
        best = [np.zeros(0, np.int64) for _ in range(3)]
        if not len(self.ids):
            return best
        plain = queries.astype(float)
        norm = np.sqrt((plain * plain).sum(axis=1))
        kth = kth.copy()
        bounds = self.bound(0, plain, norm)
        agenda = [(-bounds.max(initial=-np.inf), 0, bounds)]
        while agenda:
            _, node, bounds = heapq.heappop(agenda)
            open_for = np.flatnonzero(bounds >= kth)
            if not len(open_for):
                continue
            if self.place[node] is None:
                for child in self.child[node]:
                    below = np.full(len(kth), -np.inf)
                    below[open_for] = self.bound(child, plain[open_for], norm[open_for])
                    below[below < kth] = -np.inf
                    if np.isfinite(top := below.max()):
                        heapq.heappush(agenda, (-top, child, below))
                continue
            own = self.place[node]
            if self.radius[node] == 0:
                # equal vectors tie, so the smallest ids of them are enough
                own = own[: k + 1]
            found = self.scores(queries[open_for], own)
            other = rows[open_for][:, None] != self.rows[own][None, :]
            least = kth[open_for]
            if len(own) > k:
                # the row of the query itself may be among them, so one more is passed over
                least = np.maximum(least, np.partition(found, -(k + 1), axis=1)[:, -(k + 1)])
            q, at = np.nonzero((found >= least[:, None]) & other)
            best = [np.concatenate(pair) for pair in zip(best, (open_for[q], found[q, at], self.ids[own[at]]), strict=True)]
            ranked = np.lexsort((best[2], -best[1], best[0]))
            best = [x[ranked] for x in best]
            start = np.searchsorted(best[0], best[0])
            rank = np.arange(len(start)) - start
            best = [x[rank < k] for x in best]
            full = np.flatnonzero(rank[rank < k] == k - 1)
            kth[best[0][full]] = np.maximum(kth[best[0][full]], best[1][full])
        return best


def _searched(vectors: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """``row, query_id, vec_id, score`` of each query in each shard it was sent to."""
    both = vectors.select(
        "shard", "size", F.lit(0).alias("kind"), "row", F.col("vec_id").alias("id"), "vector", F.lit(LOWEST).alias("kth")
    ).union(queries.select("shard", "size", F.lit(1).alias("kind"), "row", "vec_id", "vector", "kth"))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "size", "kind")

    def results(tree: BallTree, asked: list[tuple]) -> pa.RecordBatch:
        row, ids, vector, kth = (list(x) for x in zip(*asked, strict=True))
        size = tree.vectors.shape[1]
        queries = np.frombuffer(b"".join(vector), np.int64).reshape(len(row), size)
        q, score, found = tree.search(queries, np.array(row, np.int64), np.array(kth, np.int64), k)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(row, np.int64)[q]), pa.array(np.array(ids, np.int64)[q]), pa.array(found), pa.array(score)],
            ["row", "query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, tree, asked = None, [], None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "size", "kind", "row", "id", "vector", "kth"))
            for shard, size, kind, row, vec_id, vector, kth in zip(*columns, strict=True):
                if (shard, size) != group:
                    if asked:
                        yield results(tree, asked)
                    group, held, tree, asked = (shard, size), [], None, []
                if kind == 0:
                    held.append((row, NO_ID if vec_id is None else vec_id, vector))
                    continue
                if tree is None:
                    own = pa.array([x for *_, x in held], pa.binary())
                    tree = BallTree(
                        matrix(own, size), np.array([x for _, x, _ in held], np.int64), np.array([x for x, *_ in held], np.int64)
                    )
                    held = []
                asked.append((row, vec_id, vector, kth))
                if len(asked) == BLOCK:
                    yield results(tree, asked)
                    asked = []
        if asked:
            yield results(tree, asked)

    return dealt.mapInArrow(run, "row long, query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` other rows of every row that ``is_query`` (of ``vec_id``)."""
    rows = cut(integers(df).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / shard_rows), min(cores, math.ceil(n / LEAST_ROWS)))
    home = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    vectors = rows.withColumn("shard", home)
    queries = rows.where(F.col("vec_id").isNotNull() & is_query)
    # any shard will do for the first wave: the one that holds the query
    near = cut(_searched(vectors, queries.withColumn("shard", home).withColumn("kth", F.lit(LOWEST)), shards, k))
    found = near
    if shards > 1:
        reached = near.groupBy("row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
        others = F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), F.array(home))
        asked = (
            queries.join(reached, "row", "left").withColumn("kth", F.coalesce("kth", F.lit(LOWEST)))
            .withColumn("shard", F.explode(others))
        )
        found = near.union(_searched(vectors, asked, shards, k))
    return _best(found, k).select(
        "query_id", F.col("rank").cast("int").alias("rank"),
        F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score",
    )
