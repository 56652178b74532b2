"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every byte covered by a string of ``STRING`` bytes that also starts elsewhere is removed.

Suffixes are sampled by content: in every run of ``WINDOW`` start positions the one with the
smallest hash of its first ``GRAM`` bytes is taken. Two equal strings choose the same place,
so a repeat always shows as two sampled suffixes that agree in at least ``HEAD`` bytes to the
right of the sample, and nothing is lost by keeping about one suffix in 75 bytes.

1. *Levels.* Suffixes are dealt out by a fingerprint of their first ``HEAD`` bytes, so suffixes
   that agree so far meet in one shard. There they arrive in runs. A run is sorted to a suffix
   array (by fingerprints of the head and of the whole surroundings), merge-scanned against
   the shard's levels, and levels of equal size are merged, as in a log-structured index: a
   suffix takes part in logarithmically many merges. A suffix whose whole surroundings occur
   twice is settled at once. One whose head occurs with other surroundings is examined.
2. *Bytes.* For these, one of each kind, the surrounding bytes are fetched and sorted in both
   directions with the longest common prefixes of neighbours, and for every offset of the
   string around the sample it is decided exactly whether the same string occurs twice.
3. The covered intervals of a text are joined and cut out.

Equal suffixes of one chunk are merged before the shuffle. Texts move by row key only.

Null texts count as empty. Texts shorter than the string lose nothing. Wholly repeated rows
are occurrences of each other. Null ids are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.hashing import Ranges, mix
from assayline.llm.shared import NO_ID, chunks, cut, row_key

STRING = 200
WINDOW = 150
GRAM = 8
HEAD = STRING - WINDOW + 1
RUN = 1 << 16
BLOCK = 1 << 14
_K = np.uint64(0x9E3779B97F4A7C15)
# Offsets of the string before the sample are decided in two groups: small ones among
# suffixes that agree far to the right, large ones among those that agree to the left.
SIDES = ((0, WINDOW // 2), (WINDOW // 2 + 1, WINDOW - 1))


def samples(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sampled positions of the texts ``data[start:end]``, in order."""
    if len(data) < STRING:
        return np.zeros(0, np.int64)
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    low = mix(np.ndarray((len(data),), np.uint64, padded, strides=(1,)))
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= np.arange(len(data), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - width)], low[WINDOW - width :])
    # windows that lie in one text
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= STRING
    inside[starts[long]] += 1
    inside[ends[long] - STRING + 1] -= 1
    chosen = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.cumsum(inside[: len(low)]) > 0]
    return chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]


class SuffixLevels:
    """Sorted runs of suffixes whose sizes grow geometrically.

    ``same`` marks suffixes whose surroundings occur again, ``other`` those whose head
    occurs with other surroundings.
    """

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, head: np.ndarray, whole: np.ndarray, same: np.ndarray, row: np.ndarray) -> None:
        run = self._sorted({"head": head, "whole": whole, "same": same.copy(), "other": np.zeros(len(head), bool), "row": row})
        equal = run["head"][1:] == run["head"][:-1]
        twin = equal & (run["whole"][1:] == run["whole"][:-1])
        run["same"][1:] |= twin
        run["same"][:-1] |= twin
        group = np.cumsum(np.concatenate([[False], ~equal]))
        varied = np.zeros(len(head), bool)
        varied[group[1:][equal & ~twin]] = True
        run["other"] |= varied[group]
        for level in self.levels:
            self._scan(run, level)
            self._scan(level, run)
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-1]["head"]) * 2 > len(self.levels[-2]["head"]):
            self._merge()

    def _merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        self.levels.append(self._sorted({k: np.concatenate([b[k], a[k]]) for k in ("head", "whole", "same", "other", "row")}))

    @staticmethod
    def _sorted(level: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        order = np.lexsort((level["whole"], level["head"]))
        out = {k: v[order] for k, v in level.items()}
        out["pairs"] = np.sort(mix(out["head"] * _K + out["whole"]))
        return out

    @staticmethod
    def _scan(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> None:
        """Mark the suffixes of ``a`` that agree with some of ``b``."""
        heads = np.searchsorted(b["head"], a["head"], "right") - np.searchsorted(b["head"], a["head"])
        hit = np.flatnonzero(heads)
        pair = mix(a["head"][hit] * _K + a["whole"][hit])
        twins = np.searchsorted(b["pairs"], pair, "right") - np.searchsorted(b["pairs"], pair)
        a["same"][hit[twins > 0]] = True
        a["other"][hit[heads[hit] > twins]] = True

    def finished(self) -> dict[str, np.ndarray]:
        """All suffixes in one level."""
        while len(self.levels) > 1:
            self._merge()
        return self.levels[0]


def covered(groups: np.ndarray, left: list[bytes], right: list[bytes], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset, from ``low`` to ``high``, at which a string occurs twice.

    ``left`` holds the bytes before the sample, ``right`` those from it on; only rows of one
    group are compared. -1 where no string does.
    """
    n = len(groups)
    left_length, right_length = (np.array([len(x) for x in side]) for side in (left, right))

    def ranked(side: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        table = np.zeros((n, 4 + width), np.uint8)
        table[:, :4] = groups.astype(">u4").view(np.uint8).reshape(n, 4)
        table[:, 4:] = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in side), np.uint8).reshape(n, width)
        order = np.argsort(table.view(f"S{4 + width}").ravel(), kind="stable")
        table = table[order]
        differ = table[1:] != table[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + width)
        return order, common

    left_order, left_common = ranked([x[::-1] for x in left], high)
    right_order, right_common = ranked(right, STRING - low)
    least, most = np.full(n, -1), np.full(n, -1)
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for offset in range(low, high + 1):
        usable = np.flatnonzero((left_length >= offset) & (right_length >= STRING - offset))
        if len(usable) < 2:
            continue
        a[left_order[1:]] = np.cumsum(left_common < 4 + offset)
        b[right_order[1:]] = np.cumsum(right_common < 4 + STRING - offset)
        a[left_order[0]] = b[right_order[0]] = 0
        name = a[usable] * n + b[usable]
        order = np.argsort(name)
        twin = name[order][1:] == name[order][:-1]
        again = np.zeros(len(name), bool)
        again[order[1:][twin]] = True
        again[order[:-1][twin]] = True
        hit = usable[again]
        most[hit] = offset
        least[hit[least[hit] < 0]] = offset
    return least, most


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _suffixes(texts: DataFrame) -> DataFrame:
    """``head, whole, d, h, at, left, right, kind``: suffixes (0), repeated in the chunk (1); settled (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch, found in chunks(batches, "text"):
            data = np.frombuffer(b"".join(found), np.uint8)
            ends = np.cumsum([len(t) for t in found])
            starts = ends - [len(t) for t in found]
            at = samples(data, starts, ends)
            if not len(at):
                continue
            text = np.searchsorted(ends, at, "right")
            left = np.minimum(at - starts[text], WINDOW - 1)
            right = np.minimum(ends[text] - at, STRING)
            hashes = Ranges(data, state)
            head = hashes(at, at + HEAD)
            whole = mix(hashes(at - left, at + right) + mix(left.astype(np.uint64)))
            _, first, back, n = np.unique(mix(head * _K + whole), return_index=True, return_inverse=True, return_counts=True)
            kind = np.where(n[back] > 1, 2, 0).astype(np.int8)
            kind[first[n > 1]] = 1
            d, h = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("d", "h"))
            # settled ones only pass through: any shard will do
            head[kind == 2] = mix(h[kind == 2].view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (
                    head.view(np.int64), whole.view(np.int64), d, h, (at - starts[text]).astype(np.int32),
                    left.astype(np.int16), right.astype(np.int16), kind)],
                ["head", "whole", "d", "h", "at", "left", "right", "kind"],
            )

    return texts.mapInArrow(
        run, "head long, whole long, d long, h long, at int, left short, right short, kind byte"
    )


def _scanned(suffixes: DataFrame) -> DataFrame:
    """``d, h, at, start, end, kind``: settled intervals (0) and samples to examine (1)."""
    names = ("d", "h", "at", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows, size = SuffixLevels(), [], 0
        waiting: list[dict[str, np.ndarray]] = []

        def flush():
            nonlocal waiting
            block = {k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]}
            index.add(block["head"].view(np.uint64), block["whole"].view(np.uint64), block["kind"] == 1, block["row"])
            waiting = []

        def out(x: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
            at = x["at"].astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (x["d"], x["h"], at, at - x["left"], at + x["right"], np.full(len(at), kind, np.int8))],
                ["d", "h", "at", "start", "end", "kind"],
            )

        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            settled = x["kind"] == 2
            if settled.any():
                yield out({k: x[k][settled] for k in names}, 0)
            x = {k: v[~settled] for k, v in x.items()}
            rows.append({k: x[k] for k in names})
            waiting.append({"head": x["head"], "whole": x["whole"], "kind": x["kind"], "row": size + np.arange(len(x["d"]))})
            size += len(x["d"])
            if sum(len(w["row"]) for w in waiting) >= RUN:
                flush()
        if not size:
            return
        if waiting and any(len(w["row"]) for w in waiting):
            flush()
        level = index.finished()
        payload = {k: np.concatenate([r[k] for r in rows]) for k in names}
        same = level["row"][level["same"]]
        first = np.ones(len(level["head"]), bool)
        first[1:] = (level["head"][1:] != level["head"][:-1]) | (level["whole"][1:] != level["whole"][:-1])
        examine = level["row"][level["other"] & first]
        for kind, chosen in ((0, same), (1, examine)):
            for i in range(0, len(chosen), RUN):
                yield out({k: payload[k][chosen[i : i + RUN]] for k in names}, kind)

    return suffixes.repartition("head").mapInArrow(
        run, "d long, h long, at int, start int, end int, kind byte"
    )


def _contexts(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, side, d, h, at, left, right``: the bytes around the samples to examine."""
    asked = found.where("kind = 1").groupBy("d", "h").agg(F.collect_list("at").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch, bodies in chunks(batches, "text"):
            data = np.frombuffer(b"".join(bodies), np.uint8)
            ends = np.cumsum([len(t) for t in bodies])
            starts = ends - [len(t) for t in bodies]
            lists = batch.column("asked").to_pylist()
            text = np.repeat(np.arange(len(bodies)), [len(x) for x in lists])
            place = np.array([p for x in lists for p in x], np.int64)
            at = place + starts[text]
            hashes, whole = Ranges(data, state), data.tobytes()
            d, h = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("d", "h"))
            for side, (low, high) in enumerate(SIDES):
                chosen = (place >= low) & (ends[text] - at >= STRING - high)
                own = text[chosen]
                here = at[chosen]
                first = np.maximum(here - high, starts[own])
                last = np.minimum(here + STRING - low, ends[own])
                key = mix(hashes(here - low, here + STRING - high) + np.uint64(side))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(np.full(len(here), side, np.int8)),
                     pa.array(d[chosen]), pa.array(h[chosen]), pa.array(place[chosen].astype(np.int32)),
                     pa.array([whole[i:j] for i, j in zip(first, here, strict=True)], pa.binary()),
                     pa.array([whole[i:j] for i, j in zip(here, last, strict=True)], pa.binary())],
                    ["key", "side", "d", "h", "at", "left", "right"],
                )

    return texts.join(asked, ["d", "h"]).mapInArrow(
        run, "key long, side byte, d long, h long, at int, left binary, right binary"
    )


def _examined(contexts: DataFrame) -> DataFrame:
    """``d, h, start, end``: intervals that strings with another occurrence cover."""

    def block(rows: list[tuple], side: int) -> pa.RecordBatch:
        low, high = SIDES[side]
        _, groups = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        least, most = covered(groups, [r[5] for r in rows], [r[6] for r in rows], low, high)
        hit = np.flatnonzero(most >= 0)
        at = np.array([rows[i][4] for i in hit], np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][2] for i in hit], pa.int64()), pa.array([rows[i][3] for i in hit], pa.int64()),
             pa.array((at - most[hit]).astype(np.int32)), pa.array((at - least[hit] + STRING).astype(np.int32))],
            ["d", "h", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by side and key; a block ends where a key ends
        held: list[tuple] = []
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[-1][:2] != row[:2]:
                    if len(group) > 1:
                        held += group
                    if held and (len(held) >= BLOCK or row[1] != held[-1][1]):
                        yield block(held, held[-1][1])
                        held = []
                    group = []
                group.append(row)
        if len(group) > 1:
            held += group
        if held:
            yield block(held, held[-1][1])

    return contexts.repartition("key").sortWithinPartitions("side", "key").mapInArrow(
        run, "d long, h long, start int, end int"
    )


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept`` of every row.

    ``kept``, the remaining bytes, is null unless they are asked for.
    """
    d, h = row_key()
    texts = docs.select(d.alias("d"), h.alias("h"), "text")
    found = cut(_scanned(_suffixes(texts)))
    spans = found.where("kind = 0").select("d", "h", "start", "end").union(
        _examined(_contexts(found, texts))
    ).groupBy("d", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in chunks(batches, "text"):
            cuts = [
                joined([(s["start"], s["end"]) for s in x or ()]) for x in batch.column("spans").to_pylist()
            ]
            kept = []
            for body, spans in zip(bodies, cuts, strict=True):
                edges = [0, *(e for span in spans for e in span), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            ids = [None if x == NO_ID else x for x in batch.column("d").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(b) for b in bodies], pa.int64()),
                 pa.array([len(b) - len(k) for b, k in zip(bodies, kept, strict=True)], pa.int64()),
                 pa.array([len(c) for c in cuts], pa.int64()),
                 pa.array([[{"start": a, "end": b} for a, b in c] for c in cuts],
                          pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                 pa.array(kept if with_bytes else [None] * len(kept), pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"],
            )

    return texts.join(spans, ["d", "h"], "left").select("d", "text", "spans").mapInArrow(
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: int, end: int>>, "
        "kept_sha256 string, kept binary",
    )
