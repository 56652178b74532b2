"""Integer vectors: what the vector operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
LARGEST = 2**27  # components are held to this, so that products of vectors fit a long


def integers(df: DataFrame, size: int | None = None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id, size, vector``: floor(256 * x) of every component, as packed 64-bit integers.

    Vectors that are null or hold a null or non-finite component are left out, and those of
    another ``size``, if one is given. A component beyond ``LARGEST`` counts as that.
    """
    source = df.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    source = source.where(F.col("vector").isNotNull())
    if size is not None:
        source = source.where(F.size("vector") == size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            values = np.asarray(pc.fill_null(vectors.flatten(), np.nan), float)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero(bad[ends] == bad[ends - lengths])
            whole = np.clip(np.floor(np.where(np.isfinite(values), values, 0) * SCALE), -LARGEST, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(good)), pa.array(lengths[good], pa.int32()),
                 pa.array([whole[ends[i] - lengths[i] : ends[i]].tobytes() for i in good], pa.binary())],
                ["vec_id", "size", "vector"],
            )

    return source.mapInArrow(run, "vec_id long, size int, vector binary")


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of packed vectors as one matrix."""
    return np.frombuffer(b"".join(vectors.to_pylist()), np.int64).reshape(len(vectors), size)
