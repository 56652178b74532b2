"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A fingerprint is a sum of wide vectors, one per paragraph (line), so it does not depend on the
order of paragraphs, and a paragraph is added or removed by adding or subtracting its
vector. It has two parts, both of 32-bit lanes modulo 2**32:

* ``LANES`` lanes of an extendable-output hash of the paragraph. Equal sums mean equal
  multisets of paragraphs.
* ``SKETCH`` lanes in which each ``GRAM``-byte string of the paragraph adds or subtracts one.
  Sums of squares of such lanes estimate sizes and differences of multisets, so the likeness
  of two documents can be read from their fingerprints alone, with a standard error of about
  ``SKETCH ** -0.5``. A paragraph shorter than a gram counts as one gram.

``fingerprints_of_edits`` needs the neighbour of every document in descending ``doc_id``. The
documents are cut into ranges of ids at quantiles, each range is sorted and streamed once, and
the first document of a range is also sent to the range before it. No task holds more than a
chunk of texts, and the texts are shuffled once.

Null texts count as empty; the empty text has one empty paragraph. Null ids come last. Rows
that repeat an id are ordered by a hash of their text. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.hashing import mix
from assayline.llm.shared import CHUNK_BYTES, row_key

LANES = 32
SKETCH = 192
GRAM = 16
MOST_RANGES = 4096


def sums(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of the texts, one row of ``LANES + SKETCH`` 32-bit lanes each."""
    out = np.zeros((len(texts), LANES + SKETCH), np.uint32)
    short_at, short = [], []
    for i, text in enumerate(texts):
        wide = []
        for paragraph in text.split(b"\n"):
            wide.append(hashlib.shake_128(paragraph).digest(4 * LANES))
            if 0 < len(paragraph) < GRAM:
                short_at.append(i)
                short.append(wide[-1][:8])
        lanes = np.frombuffer(b"".join(wide), np.uint32).reshape(-1, LANES)
        out[i, :LANES] = lanes.sum(axis=0, dtype=np.uint32)

    data = np.frombuffer(b"".join(x for t in texts for x in (t, b"\n")) + bytes(GRAM), np.uint8)
    size = len(data) - GRAM
    eight = np.ndarray((size + GRAM - 8,), np.uint64, data, strides=(1,))
    grams = eight[:size] * np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams += eight[GRAM - 8 : GRAM - 8 + size]
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0x94D049BB133111EB)
    ends = np.flatnonzero(data[:size] == 10)
    inside = np.ones(size, bool)
    for back in range(GRAM):
        at = ends - back
        inside[at[at >= 0]] = False
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[inside]
    grams = grams[inside]
    if short:
        grams = np.concatenate([grams, mix(np.frombuffer(b"".join(short), np.uint64))])
        owner = np.concatenate([owner, np.array(short_at)])
    lane = ((grams >> np.uint64(32)).astype(np.uint32) >> np.uint32(1)) % np.uint32(SKETCH)
    sign = 1.0 - 2.0 * (grams >> np.uint64(63)).astype(np.float64)
    total = np.bincount(owner * SKETCH + lane, weights=sign, minlength=len(texts) * SKETCH)
    out[:, LANES:] = total.astype(np.int64).astype(np.uint32).reshape(-1, SKETCH)
    return out


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of the union of two multisets of paragraphs."""
    return a + b


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return a - b


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Dice likeness of the grams of fingerprints, row by row; 1 if they are equal."""
    x, y = (v[:, LANES:].astype(np.int32).astype(np.float64) for v in (a, b))
    both = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.clip(2 * (x * y).sum(axis=1) / np.where(both > 0, both, 1), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, near)


def encoded(fingerprints: np.ndarray) -> list[str]:
    return [base64.b64encode(row.tobytes()).decode() for row in fingerprints]


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range(ids: Column, bounds: list[int], low: int = 0) -> Column:
    """The number of bounds not above the id, by nested halving."""
    if not bounds:
        return F.lit(low)
    middle = len(bounds) // 2
    return F.when(ids >= bounds[middle], _range(ids, bounds[middle + 1 :], low + middle + 1)).otherwise(
        _range(ids, bounds[:middle], low)
    )


def fingerprints_of_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with both likenesses."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d, h = row_key()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"), h.alias("h"),
                        F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    found = keyed.agg(F.percentile_approx("d", shares, 20 * ranges)).first()[0] if shares else []
    bounds = sorted(set(found or []))
    keyed = keyed.withColumn("range", _range(F.col("d"), bounds))
    # one number per range, at most MOST_RANGES of them
    heads = sorted(tuple(r) for r in keyed.groupBy("range").agg(F.max("d")).collect())
    sent = [F.struct("range", F.lit(0).alias("extra"))]
    if heads:
        before = [*(n for n, _ in heads[1:]), heads[0][0]]
        first = F.create_map(*(F.lit(x) for n, top in heads for x in (n, top)))
        target = F.create_map(*(F.lit(x) for (n, _), b in zip(heads, before, strict=True) for x in (n, b)))
        sent.append(F.when(
            F.col("d") == F.element_at(first, F.col("range")),
            F.struct(F.element_at(target, F.col("range")).alias("range"), F.lit(1).alias("extra")),
        ))
    rows = (
        keyed.withColumn("sent", F.explode(F.array(*sent))).where("sent is not null")
        .select("sent.range", "sent.extra", "d", "h", "doc_id", "text")
        .repartition("range")
        .sortWithinPartitions("range", "extra", F.desc("d"), "h", "text")
    )

    def emit(held: list, following: list[str]) -> pa.RecordBatch:
        texts = [x["text"] for x in held]
        changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
        raw = [t.encode() for t in changed]
        own, new = sums([t.encode() for t in texts]), sums(raw)
        last = sums([following[-1].encode()])
        return pa.RecordBatch.from_arrays(
            [pa.array([x["doc_id"] for x in held], pa.int64()),
             pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
             pa.array(encoded(own)), pa.array(encoded(new)),
             pa.array(likeness(own, new)),
             pa.array(likeness(own, np.concatenate([own[1:], last])))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # rows in order whose last has no neighbour yet
        size = 0
        passed = None  # the range whose rows all have their neighbour
        for batch in batches:
            for row in batch.select(["range", "extra", "doc_id", "text"]).to_pylist():
                if row["extra"]:
                    if held and row["range"] != passed:
                        yield emit(held, [*(x["text"] for x in held[1:]), row["text"]])
                        held, size = [], 0
                    passed = row["range"]
                    continue
                held.append(row)
                size += len(row["text"])
                if size >= CHUNK_BYTES and len(held) > 1:
                    yield emit(held[:-1], [x["text"] for x in held[1:]])
                    held = held[-1:]
                    size = len(held[0]["text"])

    return rows.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
