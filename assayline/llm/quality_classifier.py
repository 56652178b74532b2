"""Quality classifier by co-training a text view and a metadata view.

A document is bad when its label says low quality or toxic. Two logistic classifiers see
different views of it: the text view its style (shares of symbols, capitals and repeated words
and the like) and which words of a vocabulary occur; the metadata view its length, language
and source. Both start from the labelled documents. In every round each view labels, among
all unlabelled documents, those of which it is confident, and the other view learns from
them by a step whose sums executors add up (Newton's, with a curvature that cannot overshoot). A
view may teach only as far as it is right on labelled documents it has not seen: its bounds are
those at which its precision there, with one wrong answer added, is at least ``TRUST``, and it teaches
no label that it does not believe itself. A step that raises the mean loss on those documents by more
than ``SLACK`` is undone.

Labelled documents fall into ``FOLDS`` folds by a hash of their id. Co-training runs once for
each fold set aside, all of them in the same passes. Both views are calibrated on the scores that
every labelled document gets from the run which has not seen it, a third logistic model on the two
calibrated log-odds combines them, and all documents are scored by the mean of the runs.

The fit is bounded in labelled rows only: at most ``MOST_LABELLED``, those with the smallest
hashes of their ids. Words are counted on executors; a word enters the vocabulary by the
smallest of its deviations over the folds, so words that stand out in one fold by chance stay
out. The driver sees counts, sums, and the features of labelled documents.

Null texts count as empty, null languages and sources as a value of their own, and a null
``n_chars`` as the length of the text. Repeated labels of a document count once, bad if any
of them is. Of rows that repeat a labelled id, the one with the smallest hash of its text is
learnt from. Unless every fold has labels of both kinds nothing can be learnt: every document scores 0.
Repeated rows score the same. Columns of the input are kept; score columns replace input
columns of the same names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.shared import cut

MOST_LABELLED = 12_000
VOCABULARY = 200
LEAST_SEEN = 5
LEAST_DEVIATION = 1.0
FOLDS = 3
ROUNDS = 3
TRUST = 0.98
SLACK = 0.02
LIMIT = 0.5
BUCKETS = 64
BLOCK = 2048
ADDED = ("text_score", "meta_score", "score", "rejected")

_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s]")
_ODD_END = re.compile(r"[*#$%&!|=~^](?=\s|$)")
_DIGIT = re.compile(r"\d")
STYLE = 10


def style(text: str) -> tuple[list[float], set[str]]:
    """Style features of a text and the set of its lower-cased words."""
    words = _WORD.findall(text.lower())
    distinct = set(words)
    n, size = max(1, len(words)), max(1, len(text))
    symbols = _SYMBOL.findall(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        len(symbols) / size, sum(map(str.isupper, text.split())) / n, sum(map(eq, words, words[1:])) / n,
        len(_ODD_END.findall(text)) / n, len(distinct) / n,
        max(Counter(symbols).values(), default=0) / n, math.log1p(len(words)), sum(map(len, words)) / n / 10,
        len({*lines}) / max(1, len(lines)), len(_DIGIT.findall(text)) / size,
    ], distinct


def buckets(lang: str | None, source: str | None) -> tuple[int, int]:
    """Hashed buckets of language and source."""
    return tuple(i * BUCKETS + zlib.crc32(repr(x).encode()) % BUCKETS for i, x in enumerate((lang, source)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Coefficients (intercept last) by Newton's method with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        step = np.linalg.solve(*_newton(x, y, w, penalty))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _ridge(size: int, n: float, penalty: float) -> np.ndarray:
    ridge = np.full(size, penalty * n)
    ridge[-1] = 1e-9
    return ridge


def _newton(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1e-3, safe: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Curvature and slope of the penalised loss; x ends in ones."""
    ridge = _ridge(len(w), len(x), penalty)
    slope, curve = _sums(x, y, w, safe)
    return curve + np.diag(ridge), slope + ridge * w


def _sums(x: np.ndarray, y, w: np.ndarray, safe: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the loss; a ``safe`` curvature bounds the loss from above.

    Far from 0 the true curvature vanishes and a full step overshoots. The bound touches the loss at
    the present scores, so that a step by it never raises the loss.
    """
    score = np.clip(x @ w, -30, 30)
    p = _probability(score)
    if safe:
        far = np.abs(score) > 1e-6
        curvature = np.full(len(score), 0.25)
        curvature[far] = (p[far] - 0.5) / score[far]
    else:
        curvature = p * (1 - p) + 1e-6
    return x.T @ (p - y), (x * curvature[:, None]).T @ x


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _probability(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _loss(score: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -score, score))))


@dataclass
class Features:
    """How rows become standardised matrices of either view; small, so it travels with functions."""

    words: dict[str, int]
    moments: list[tuple[np.ndarray, np.ndarray]]

    def views(self, style_rows, word_rows, size: np.ndarray, bucket_rows) -> list[np.ndarray]:
        x, m = self.raw(style_rows, word_rows, size, bucket_rows)
        return [(raw - mean) / scale for raw, (mean, scale) in zip((x, m), self.moments, strict=True)]

    def raw(self, style_rows, word_rows, size: np.ndarray, bucket_rows) -> tuple[np.ndarray, np.ndarray]:
        n = len(size)
        x = np.zeros((n, STYLE + len(self.words)))
        x[:, :STYLE] = np.asarray(style_rows, float).reshape(n, STYLE)
        lengths = [len(w) for w in word_rows]
        at = np.fromiter((i for w in word_rows for i in w), int, sum(lengths))
        x[np.repeat(np.arange(n), lengths), STYLE + at] = 1.0
        m = np.zeros((n, 1 + 2 * BUCKETS))
        m[:, 0] = np.log1p(size)
        m[np.arange(n)[:, None], 1 + np.asarray(bucket_rows, int).reshape(n, 2)] = 1.0
        return x, m

    def of_batch(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        return self.views(*self.columns(batch))

    @staticmethod
    def columns(batch) -> tuple:
        return (
            batch.column("style").to_pylist(), batch.column("words").to_pylist(),
            np.asarray(batch.column("size")),
            batch.column("buckets").to_pylist(),
        )


@dataclass
class Model:
    """What scoring needs; small, so it travels with the function."""

    features: Features
    weights: list[list[np.ndarray]]  # by fold set aside, then view
    calibration: list[np.ndarray]
    combine: np.ndarray

    def views(self, texts: list[str], langs: list, sources: list, sizes: np.ndarray) -> list[np.ndarray]:
        """Calibrated log-odds of being bad by either view."""
        found = [style(t) for t in texts]
        words = self.features.words
        both = self.features.views(
            [s for s, _ in found], [[words[w] for w in own & words.keys()] for _, own in found], sizes,
            [buckets(*x) for x in zip(langs, sources, strict=True)],
        )
        mean = [np.mean([odds(x, w[k]) for w in self.weights], axis=0) for k, x in enumerate(both)]
        return [odds(x[:, None], fit) for x, fit in zip(mean, self.calibration, strict=True)]


def _bounds(score: np.ndarray, bad: np.ndarray, trust: float) -> tuple[float, float]:
    """Log-odds up to and from which unseen documents are good or bad with ``trust``."""
    out = []
    for order, right in ((np.argsort(score, kind="stable"), ~bad), (np.argsort(-score, kind="stable"), bad)):
        # one wrong answer more than was seen
        sure = np.cumsum(right[order]) / np.arange(2, len(order) + 2) >= trust
        out.append(score[order][np.flatnonzero(sure)[-1]] if sure.any() else None)
    low, high = out
    # a view teaches no label that it does not believe itself
    return (-np.inf if low is None else min(low, 0.0)), (np.inf if high is None else max(high, 0.0))


def _known(labels: DataFrame, most: int) -> DataFrame:
    """``id, bad, fold`` of at most ``most`` labelled documents."""
    bad = ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    return (
        labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(bad).alias("bad"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
        .withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int"))
    )


def _plain(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), text.alias("text"), "lang", "source",
        F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long")).alias("size"),
    )


def _vocabulary(labelled: DataFrame, sizes: dict[tuple[int, int], int], most: int) -> dict[str, int]:
    """The words whose document frequency differs most between bad and good documents in every fold.

    The difference is measured in standard errors, and the fold where it is least counts;
    words seen in fewer than ``LEAST_SEEN`` documents, or deviating there by less than
    ``LEAST_DEVIATION``, are left out.
    """
    words = F.array_distinct(F.split(F.lower("text"), r"(?U)\W+"))
    keys = [(k, y) for k in range(FOLDS) for y in (0, 1)]
    counts = labelled.select("fold", "bad", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if((F.col("fold") == k) & (F.col("bad") == y)).alias(f"n{k}{y}") for k, y in keys),
    ).where(F.col("n") >= LEAST_SEEN)

    def deviation(k: int):
        good, ill = max(1, sizes.get((k, 0), 0)), max(1, sizes.get((k, 1), 0))
        share = (F.col(f"n{k}0") + F.col(f"n{k}1")) / (good + ill)
        error = F.sqrt(share * (1 - share) * (1 / good + 1 / ill) + 1e-12)
        return (F.col(f"n{k}1") / ill - F.col(f"n{k}0") / good) / error

    z = [deviation(k) for k in range(FOLDS)]
    least = F.greatest(F.least(*z), -F.greatest(*z))
    best = counts.select("word", F.round(least, 9).alias("z")).where(F.col("z") >= LEAST_DEVIATION).orderBy(F.desc("z"), "word").limit(most)
    return {r["word"]: i for i, r in enumerate(best.collect())}


def _featured(docs: DataFrame, known: DataFrame, words: dict[str, int]) -> DataFrame:
    """Features of all documents, with ``bad`` and ``fold`` where they are labelled."""
    # at most MOST_LABELLED labels, so they may be broadcast
    source = _plain(docs).join(F.broadcast(known), "id", "left").withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                found = [style(t) for t in batch.column("text").to_pylist()]
                near = [
                    list(buckets(*x))
                    for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("id", "h", "bad", "fold", "size")),
                     pa.array([x for x, _ in found], pa.list_(pa.float64())),
                     pa.array([sorted(words[w] for w in own & words.keys()) for _, own in found], pa.list_(pa.int32())),
                     pa.array(near, pa.list_(pa.int32()))],
                    ["id", "h", "bad", "fold", "size", "style", "words", "buckets"],
                )

    return source.mapInArrow(
        run, "id long, h long, bad int, fold int, size long, style array<double>, words array<int>, buckets array<int>"
    )


def _taught(pool: DataFrame, features: Features, weights: list, bounds: list) -> dict[tuple[int, int, int], tuple]:
    """Sums over what each view is taught by the other: by (fold, student, class), n, slope, curvature.

    Every partition yields one row a key; they are added up in two steps, so no task reads
    more than about the square root of their number.
    """
    parts = pool.rdd.getNumPartitions()
    keys = [(k, view, y) for k in range(FOLDS) for view in (0, 1) for y in (0, 1)]
    sizes = [len(w) for w in weights[0]]
    upper = [np.triu_indices(n) for n in sizes]

    def empty() -> list[np.ndarray]:
        return [np.zeros(1 + sizes[v] + len(upper[v][0])) for _, v, _ in keys]

    def packed(total: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(keys)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["k", "sums"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty()
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                views = features.of_batch(whole.slice(start, BLOCK))
                wide = [np.hstack([x, np.ones((len(x), 1))]) for x in views]
                for out, (k, student, y) in zip(total, keys, strict=True):
                    score = odds(views[1 - student], weights[k][1 - student])
                    low, high = bounds[k][1 - student]
                    sure = wide[student][score >= high if y else score <= low]
                    if len(sure):
                        slope, curve = _sums(sure, float(y), weights[k][student], safe=True)
                        out += np.concatenate([[len(sure)], slope, curve[upper[student]]])
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = empty()
        for batch in batches:
            for k, sums in zip(batch.column("k").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[k] += np.frombuffer(sums)
        yield packed(total)

    schema = "k int, sums binary"
    sums = pool.mapInArrow(run, schema)
    for n in (math.ceil(math.sqrt(parts)), 1):
        sums = sums.repartition(n).mapInArrow(add, schema)
    out = {}
    for r in sums.collect():
        k, view, y = keys[r["k"]]
        flat = np.frombuffer(r["sums"])
        curve = np.zeros((sizes[view], sizes[view]))
        curve[upper[view]] = flat[1 + sizes[view] :]
        out[k, view, y] = flat[0], flat[1 : 1 + sizes[view]], curve + np.triu(curve, 1).T
    return out


def fit(
    docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, vocabulary: int = VOCABULARY,
    rounds: int = ROUNDS, trust: float = TRUST,
) -> Model | None:
    """Co-train both views; nothing unless every fold has labels of both kinds."""
    known = cut(_known(labels, most_labelled))
    labelled = _plain(docs).join(F.broadcast(known), "id")
    sizes = {(r["fold"], r["bad"]): r["count"] for r in labelled.groupBy("fold", "bad").count().collect()}
    if any((k, y) not in sizes for k in range(FOLDS) for y in (0, 1)):
        return None
    words = _vocabulary(labelled, sizes, vocabulary)
    table = cut(_featured(docs, known, words))
    row = F.struct("bad", "fold", "size", "style", "words", "buckets")
    learnt = (
        table.where("bad is not null").groupBy("id").agg(F.min_by(row, "h").alias("r")).select("id", "r.*")
        .toArrow().sort_by("id")
    )
    bad, fold = (learnt.column(c).to_numpy() for c in ("bad", "fold"))
    y = bad.astype(float)
    if any(not np.any((fold == k) & (bad == b)) for k in range(FOLDS) for b in (0, 1)):
        return None
    raw = Features(words, []).raw(*Features.columns(learnt))
    scales = [np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0) for x in raw]
    features = Features(words, [(x.mean(axis=0), s) for x, s in zip(raw, scales, strict=True)])
    views = features.views(*Features.columns(learnt))
    wide = [np.hstack([x, np.ones((len(x), 1))]) for x in views]
    seen = [fold != k for k in range(FOLDS)]
    weights = [[_rounded(logistic(x[s], y[s])) for x in views] for s in seen]
    pool = table.where("bad is null")
    for _ in range(rounds):
        aside = [[odds(x[~s], w) for x, w in zip(views, own, strict=True)] for s, own in zip(seen, weights, strict=True)]
        bounds = [[_bounds(score, bad[~s] == 1, trust) for score in own] for s, own in zip(seen, aside, strict=True)]
        if not np.isfinite(np.array(bounds)).any():
            break
        sums = _taught(pool, features, weights, bounds)
        for k, s in enumerate(seen):
            for view in (0, 1):
                w = weights[k][view]
                curve, slope = _newton(wide[view][s], y[s], w, safe=True)
                for label in (0, 1):
                    n, more_slope, more_curve = sums[k, view, label]
                    # what is taught weighs as much as what is known, however large the corpus is
                    share = min(1.0, np.sum(bad[s] == label) / n) if n else 0.0
                    slope, curve = slope + share * more_slope, curve + share * more_curve
                step = _rounded(w - np.linalg.solve(curve, slope))
                if _loss(odds(views[view][~s], step), y[~s]) <= _loss(aside[k][view], y[~s]) + SLACK:
                    weights[k][view] = step
    apart = [np.zeros(len(y)) for _ in views]
    for own, s in zip(weights, seen, strict=True):
        for out, x, w in zip(apart, views, own, strict=True):
            out[~s] = odds(x[~s], w)
    calibration = [logistic(out[:, None], y) for out in apart]
    both = np.stack([odds(out[:, None], c) for out, c in zip(apart, calibration, strict=True)], axis=1)
    return Model(features, weights, calibration, logistic(both, y))


def _rounded(w: np.ndarray) -> np.ndarray:
    """Weights without the digits that depend on the order in which partitions are added."""
    return np.round(w, 5)


def score(docs: DataFrame, model: Model | None, limit: float = LIMIT) -> DataFrame:
    """The input with ``text_score, meta_score, score, rejected``: probabilities of being bad."""
    kept = [c for c in docs.columns if c not in ADDED]
    if model is None:
        return docs.select(
            *(F.col(f"`{c}`") for c in kept), *(F.lit(0.0).alias(c) for c in ADDED[:3]), F.lit(False).alias("rejected")
        )
    columns = [f"c{i}" for i in range(len(kept))]
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long"))
    source = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, columns, strict=True)),
        text.alias("v_text"), F.col("lang").alias("v_lang"), F.col("source").alias("v_source"), size.alias("v_size"),
    )
    schema = source.select(*columns).schema
    for name in ADDED[:3]:
        schema = schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                texts, langs, sources = (batch.column(c).to_pylist() for c in ("v_text", "v_lang", "v_source"))
                views = model.views(texts, langs, sources, batch.column("v_size").to_numpy())
                total = odds(np.stack(views, axis=1), model.combine)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), *(pa.array(_probability(x)) for x in (*views, total))],
                    [*columns, *ADDED[:3]],
                )

    scored = source.mapInArrow(run, schema)
    return scored.select(
        *(F.col(n).alias(c) for n, c in zip(columns, kept, strict=True)), *ADDED[:3],
        (F.col("score") >= limit).alias("rejected"),
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled documents and the pool of all others, and score them all."""
    return score(docs, fit(docs, labels))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with the columns of the input, whatever their names."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    needed = [F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    return classify(docs.select(row, *needed), labels).where("not rejected").select("row.*")
