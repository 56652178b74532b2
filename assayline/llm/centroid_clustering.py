"""Centroid clustering with PCA-rotated filtering: exact assignments from cheap lower bounds.

Every vector is stored with its leading coordinates in a rotated basis and the norm of what
the basis leaves out. For a vector v and a centroid c, |P v - P c|**2 + (r_v - r_c)**2, where P
gives the leading coordinates and r the residual norms, is at most |v - c|**2: the rest of the
difference is at least as long as the difference of the rests. The centroid with the least
bound is measured in integers; only centroids whose bound, less a margin for rounding, does not
exceed that distance are measured too. Distances and ties are decided in integers, so the
rotation affects the work but never the result. It is fitted on at most ``FIT_ROWS`` vectors, those
with the smallest hashes.

A round is one map over the checkpointed vectors; every partition sums its vectors by cluster,
and the driver gets one row per cluster.

Vectors that are null, of another size, or hold null or non-finite components are left out. A
null id hashes as the empty string; repeated ids are vectors of their own, ordered by their
components where hashes tie. With fewer vectors than centroids every vector starts one; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.shared import cut
from assayline.llm.vectors import integers, matrix

CENTROIDS = 40
ROUNDS = 5
SIZE = 64
LEAD = 24
FIT_ROWS = 4096
BLOCK = 4096


def rotation(sample: np.ndarray, lead: int) -> np.ndarray:
    """Orthonormal columns along which the sample varies most."""
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1][:, :lead]


def rotated(vectors: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and residual norms."""
    plain = vectors.astype(float)
    lead = plain @ basis
    rest = (plain * plain).sum(axis=1) - (lead * lead).sum(axis=1)
    return lead, np.sqrt(np.maximum(rest, 0))


def nearest(
    vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, basis: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each vector, ties to the smaller number."""
    c_lead, c_rest = rotated(centroids, basis)
    own = (lead * lead).sum(axis=1) + rest * rest
    theirs = (c_lead * c_lead).sum(axis=1) + c_rest * c_rest
    low = own[:, None] + theirs - 2 * (lead @ c_lead.T + np.outer(rest, c_rest))
    low -= 1e-9 * (own[:, None] + theirs) + 1e-6  # a margin far above the rounding of the bound
    cluster = low.argmin(axis=1)
    distance = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
    for k in range(len(centroids)):
        at = np.flatnonzero((low[:, k] <= distance) & (cluster != k))
        if len(at):
            found = ((vectors[at] - centroids[k]) ** 2).sum(axis=1)
            better = (found < distance[at]) | ((found == distance[at]) & (k < cluster[at]))
            cluster[at[better]], distance[at[better]] = k, found[better]
    return cluster, distance


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            lead = np.frombuffer(b"".join(batch.column("lead").to_pylist())).reshape(batch.num_rows, -1)
            yield batch, matrix(batch.column("vector"), size), lead, batch.column("rest").to_numpy()


def _sums(table: DataFrame, centroids: np.ndarray, basis: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        for _, vectors, lead, rest in _blocks(batches, size):
            cluster, _ = nearest(vectors, lead, rest, centroids, basis)
            count += np.bincount(cluster, minlength=len(count))
            np.add.at(total, cluster, vectors)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(count[held]), pa.array(total[held].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
    rows = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(size))).alias("total")
    ).collect()
    return {r["cluster"]: (r["n"], r["total"]) for r in rows}


def cluster(
    df: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, lead: int = LEAD
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector of ``size`` components, and the final centroids."""
    kept = cut(integers(df, size))
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("vector", name.alias("name")).orderBy("name", "vector").limit(max(FIT_ROWS, centroids)).toArrow()
    if not first.num_rows:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, size), np.int64)
    first = first.sort_by([("name", "ascending")])  # equal names keep the order of their components
    sample = matrix(first.column("vector"), size)
    basis = rotation(sample.astype(float), min(lead, size))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                coordinates, rest = rotated(matrix(batch.column("vector"), size), basis)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vector"),
                     pa.array([x.tobytes() for x in coordinates], pa.binary()), pa.array(rest)],
                    ["vec_id", "vector", "lead", "rest"],
                )

    table = cut(kept.mapInArrow(stored, "vec_id long, vector binary, lead binary, rest double"))
    now = sample[:centroids].copy()
    for _ in range(rounds):
        for k, (n, total) in _sums(table, now, basis).items():
            now[k] = [x // n for x in total]
    final = now

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, vectors, coordinates, rest in _blocks(batches, size):
            found, distance = nearest(vectors, coordinates, rest, final, basis)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(found, pa.int32()), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    return table.mapInArrow(assigned, "vec_id long, cluster int, distance long"), final


def clustered(df: DataFrame) -> DataFrame:
    """The assignments with ``cluster_inertia``, ``inertia`` and ``centroid_sha256``."""
    found, centroids = cluster(df)
    found = cut(found)
    totals = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    whole = sum(r["cluster_inertia"] for r in totals) if all(r["cluster_inertia"] is not None for r in totals) else None
    # one row per cluster
    facts = found.sparkSession.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], whole, names[r["cluster"]]) for r in totals],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
