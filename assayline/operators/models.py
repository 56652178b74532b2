"""Hooks for model scores: load once per task, score bounded batches, keep failures to their rows.

Every hook unpacks its batch in runs of rows (see ``functions.batches``) and cuts what it gives a model into chunks of a bounded number of texts and characters,
across rows, and puts the answers together again by row. A chunk that fails is split until
the failing rows alone carry the error (see ``functions.batches``). ``Slot.model_error`` names a
column of such errors; the evaluators that read model columns turn them into error rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded, halved, in_runs
from ..functions.text import split_sentences
from ..functions.vectors import best_vector, cosines_with, stacked
from ..settings import Slot
from .shared import source_sentences

Embedder = Callable[[list[str]], np.ndarray]
# (source, sentence) pairs -> probabilities of contradiction, entailment and neutrality
PairModel = Callable[[list[tuple[str, str]]], np.ndarray]
ToxicityModel = Callable[[list[str]], list[dict[str, float]]]

MOST_TEXTS = 4096
MOST_CHARS = 1 << 22

_MATCHES = pa.list_(pa.struct([("similarity", pa.float64()), ("position", pa.int32())]))
_NLI = pa.list_(pa.struct([(n, pa.float64()) for n in ("contradiction", "entailment", "neutral")]))


def _hook(function: Callable, result: str) -> Callable[..., Column]:
    """An Arrow UDF that is computed once, however often its result is used."""
    return F.arrow_udf(function, result).asNondeterministic()


def with_embedding_scores(
    df: DataFrame, load_embedder: Callable[[], Embedder], slot: Slot = Slot(),
    most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS,
) -> DataFrame:
    """Add ``similarity``, ``claim_matches`` and ``embedding_error`` of a slot from an embedding model.

    Each text is embedded once: the source is one more item of its row's list of sentences.
    Vectors live as long as their chunk of rows and never leave the function. A row whose texts
    cannot be embedded, or get vectors of different sizes, has an error and no scores.
    """
    loaded: list[Embedder] = []

    def embedded(rows: list[tuple[list[str], list[str], str]]) -> list[tuple]:
        texts = [t for own, evidence, source in rows for t in (*own, *evidence, source)]
        vectors = stacked(
            [loaded[0](texts[a:b]) for a, b in bounded([len(t) for t in texts], most_chars, most_texts)], len(texts)
        )
        out, at = [], 0
        for own, evidence, _ in rows:
            mine, theirs = vectors[at : at + len(own)], vectors[at + len(own) : at + len(own) + len(evidence)]
            at += len(own) + len(evidence) + 1
            similarity, position = best_vector(mine, theirs)
            matches = [{"similarity": s, "position": p} for s, p in zip(similarity, position, strict=True)]
            out.append((cosines_with(mine, vectors[at - 1]), matches))
        return out

    def score_run(own: pa.Array, evidence: pa.Array, source: pa.Array) -> pa.Array:
        rows = list(zip(own.to_pylist(), evidence.to_pylist(), source.to_pylist(), strict=True))
        asked = [i for i, (sentences, _, _) in enumerate(rows) if sentences]
        answers: list = [(([], []), None)] * len(rows)
        sizes = [len(rows[i][0]) + len(rows[i][1]) + 1 for i in asked]
        for a, b in bounded(sizes, most_texts, most_texts):
            for i, answer in zip(asked[a:b], halved(embedded, [rows[i] for i in asked[a:b]]), strict=True):
                answers[i] = answer
        found = [result or (None, None) for result, _ in answers]
        return pa.StructArray.from_arrays(
            [pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([m for _, m in found], _MATCHES),
             pa.array([e for _, e in answers], pa.string())],
            ["similarity", "claim_matches", "error"],
        )

    def score(own: pa.Array, evidence: pa.Array, source: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(load_embedder())
        return in_runs(score_run, own, evidence, source)

    source = F.coalesce(F.col(slot.source), F.lit(""))
    own = F.coalesce(split_sentences(F.col(slot.text)), F.array().cast("array<string>"))
    hook = _hook(
        score, "struct<similarity:array<double>,claim_matches:array<struct<similarity:double,position:int>>,error:string>"
    )
    scored = df.withColumn("_scores", hook(own, source_sentences(source), source))
    return scored.withColumns(
        {
            slot.out("similarity"): F.col("_scores.similarity"),
            slot.out("claim_matches"): F.col("_scores.claim_matches"),
            slot.out("embedding_error"): F.col("_scores.error"),
        }
    ).drop("_scores")


def probabilities(model: PairModel, pairs: list[tuple[str, str]]) -> np.ndarray:
    """The model's answer for all pairs, checked: three finite numbers each."""
    found = np.asarray(model(pairs), dtype=np.float64)
    if found.shape != (len(pairs), 3) or not np.isfinite(found).all():
        raise ValueError("the model has to give three finite probabilities for a pair")
    return found


def with_nli_scores(
    df: DataFrame, load_model: Callable[[], PairModel], slot: Slot = Slot(),
    most_pairs: int = MOST_TEXTS, most_chars: int = MOST_CHARS,
) -> DataFrame:
    """Add ``nli`` and ``nli_error`` of a slot: probabilities for (source, sentence) pairs.

    Pairs of many rows share a call, of at most ``most_pairs`` pairs and ``most_chars`` characters
    (one pair at least), so neither a long source with many sentences nor a batch of many rows
    grows a call. A row with a failing pair has an error and no scores.
    """
    loaded: list[PairModel] = []

    def score_run(source: pa.Array, sentences: pa.Array) -> pa.Array:
        sources, owned = source.to_pylist(), sentences.to_pylist()
        owners = [(row, s) for row, own in enumerate(owned) for s in own or ()]
        found: list[list | None] = [None if own is None else [] for own in owned]
        errors: list[str | None] = [None] * len(sources)
        for a, b in bounded([len(sources[row]) + len(s) for row, s in owners], most_chars, most_pairs):
            pairs = [(sources[row], s) for row, s in owners[a:b]]
            answers = halved(lambda some: probabilities(loaded[0], some), pairs)
            for (row, _), (answer, error) in zip(owners[a:b], answers, strict=True):
                errors[row] = errors[row] or error
                if error is None:
                    contradiction, entailment, neutral = answer.tolist()
                    found[row].append(
                        {"contradiction": contradiction, "entailment": entailment, "neutral": neutral}
                    )
        whole = [None if error else own for own, error in zip(found, errors, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array(whole, _NLI), pa.array(errors, pa.string())], ["nli", "error"]
        )

    def score(source: pa.Array, sentences: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(load_model())
        return in_runs(score_run, source, sentences)

    hook = _hook(
        score, "struct<nli:array<struct<contradiction:double,entailment:double,neutral:double>>,error:string>"
    )
    source = F.coalesce(F.col(slot.source), F.lit(""))
    scored = df.withColumn("_scores", hook(source, split_sentences(F.col(slot.text))))
    return scored.withColumns(
        {slot.out("nli"): F.col("_scores.nli"), slot.out("nli_error"): F.col("_scores.error")}
    ).drop("_scores")


def toxicity_scorer(
    load_model: Callable[[], ToxicityModel], most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS
) -> Callable[[Column], Column]:
    """Column function text -> struct<scores map, error>; a null text has neither."""
    loaded: list[ToxicityModel] = []

    def score_run(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        asked = [i for i, t in enumerate(rows) if t is not None]
        answers: list = [(None, None)] * len(rows)
        for a, b in bounded([len(rows[i]) for i in asked], most_chars, most_texts):
            for i, answer in zip(asked[a:b], halved(loaded[0], [rows[i] for i in asked[a:b]]), strict=True):
                answers[i] = answer
        return pa.StructArray.from_arrays(
            [pa.array([s and list(s.items()) for s, _ in answers], pa.map_(pa.string(), pa.float64())),
             pa.array([e for _, e in answers], pa.string())],
            ["scores", "error"],
        )

    def score(texts: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(load_model())
        return in_runs(score_run, texts)

    return _hook(score, "struct<scores:map<string,double>,error:string>")
