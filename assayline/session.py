"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# What Spark sends to an Arrow function at a time, bytes. A worker holds two such batches, the JVM one for every task
# outside of its heap, together with the rows that wait for their results.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}

# Recommended for every session; none of them is required for right results.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Text columns make wide rows: bound the Arrow batches by size, not only by row count.
    _BATCH_KEY: str(BATCH_BYTES),
    # Evaluators are large expressions; recording a call site for each node is slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def recommended(builder):
    """A session builder with the recommended settings."""
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([bkmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << _UNITS[unit]


def bound_batches(spark: SparkSession) -> None:
    """Have the Arrow functions of this session get at most :data:`BATCH_BYTES` (and a row) at a time from now on.

    The setting is read when a query runs, so it stays. A smaller one is left as it is.
    """
    if not 0 < _bytes(spark.conf.get(_BATCH_KEY)) <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has cores.

    A large table already has more splits than cores and is returned as it is, so this
    never moves it. A small one (a single row group is a single split) is redistributed,
    because the text work behind it is CPU-bound.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that every executor can see.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only where that is
    unset, as in local tests, a local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="assayline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
