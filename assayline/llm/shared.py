"""What the operators of this package share: cut points, byte-balanced chunks, row keys."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
NO_ID = -(2**63)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is unset, as in
    local tests, a local folder is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="assayline-checkpoints-"))
    return df.checkpoint()


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two columns that name a row by its content: ``doc_id`` and a hash of the text.

    Rows that repeat an id with another text differ; wholly repeated rows share the key, and
    their results are equal anyway. A null id counts as the smallest long.
    """
    return (
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    )


def chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with about ``CHUNK_BYTES`` of text each, one row at least.

    Yields the slice and its texts as UTF-8 bytes (null: empty).
    """
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, text in enumerate(texts):
            if i > start and size + len(text) > CHUNK_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if len(texts) > start:
            yield batch.slice(start), texts[start:]
