"""Evaluators by name, and the scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded, halved, in_runs
from ..schema import WARNING, flag
from ..session import bound_batches
from ..settings import BUILT_IN, Settings, Slot
from .factual import evaluate_factual, lexical_claims
from .hallucination import evaluate_hallucination, lexical_grounding
from .quality import evaluate_quality, quality_counts
from .results import add_result
from .safety import brand_matches, evaluate_safety
from .shared import missing_text, without_shared

# (rows, slot, settings of the evaluator) -> rows with the evaluator's result columns
Evaluator = Callable[[DataFrame, Slot, object], DataFrame]

_EVALUATORS: dict[str, Evaluator] = {
    "hallucination": evaluate_hallucination,
    "factual_accuracy": evaluate_factual,
    "content_safety": evaluate_safety,
    "quality": evaluate_quality,
}

# What these evaluators have computed in Python: (rows, slot, settings) -> rows with the inputs, columns.
_IN_PYTHON = {
    evaluate_hallucination: lexical_grounding,
    evaluate_factual: lexical_claims,
    evaluate_safety: brand_matches,
    evaluate_quality: quality_counts,
}


def register(name: str) -> Callable[[Evaluator], Evaluator]:
    """Decorator that adds an evaluator, or replaces one, under ``name``."""

    def add(evaluator: Evaluator) -> Evaluator:
        _EVALUATORS[name] = evaluator
        return evaluator

    return add


def from_function(
    name: str,
    load_scorer: Callable[[], Callable[[list[dict]], list[dict]]],
    most_rows: int = 1024,
    most_chars: int = 1 << 22,
) -> Evaluator:
    """An evaluator from a Python function over batches of ``{text, source, prompt}``.

    Each answer has a ``score`` in 0..1 and, as it likes, ``passed`` and ``categories`` (the flags, all
    warnings). ``load_scorer`` runs once per task. Where the function raises, or gives no valid
    score, only the rows that fail become error rows.
    """

    def evaluator(df: DataFrame, slot: Slot, settings: object) -> DataFrame:
        loaded: list = []

        def checked(rows: list[dict]) -> list[tuple]:
            answers = loaded[0](rows)
            out = []
            for answer in answers:
                score = float(answer["score"])
                if not 0.0 <= score <= 1.0:
                    raise ValueError(f"a score has to be from 0 to 1, not {score}")
                out.append((score, bool(answer.get("passed", True)), [str(c) for c in answer.get("categories", ())]))
            return out

        def score_run(text: pa.Array, source: pa.Array, prompt: pa.Array) -> pa.Array:
            rows = [
                dict(zip(("text", "source", "prompt"), values, strict=True))
                for values in zip(text.to_pylist(), source.to_pylist(), prompt.to_pylist(), strict=True)
            ]
            asked = [i for i, row in enumerate(rows) if row["text"] is not None]
            answers: list = [(None, None)] * len(rows)
            sizes = [sum(len(x or "") for x in rows[i].values()) for i in asked]
            for a, b in bounded(sizes, most_chars, most_rows):
                for i, answer in zip(asked[a:b], halved(checked, [rows[i] for i in asked[a:b]]), strict=True):
                    answers[i] = answer
            found = [result or (None, None, None) for result, _ in answers]
            return pa.StructArray.from_arrays(
                [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.bool_()),
                 pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([e for _, e in answers], pa.string())],
                ["score", "passed", "categories", "error"],
            )

        def score(text: pa.Array, source: pa.Array, prompt: pa.Array) -> pa.Array:
            if not loaded:
                loaded.append(load_scorer())
            return in_runs(score_run, text, source, prompt)

        hook = F.arrow_udf(
            score, "struct<score:double,passed:boolean,categories:array<string>,error:string>"
        ).asNondeterministic()
        inputs = [
            F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
            for c in (slot.text, slot.source, slot.prompt)
        ]
        answer = slot.temp(f"{name}_answer")
        df = df.withColumn(answer, hook(*inputs))
        categories = F.col(f"{answer}.categories")
        return add_result(
            df, slot, name,
            score=F.col(f"{answer}.score"),
            error=F.coalesce(missing_text(slot), F.col(f"{answer}.error")),
            sub_scores=dict,
            has_sub_scores=F.lit(False),
            passed=lambda: F.col(f"{answer}.passed"),
            categories=lambda: categories,
            flags=lambda: F.transform(categories, lambda c: flag(c, c, WARNING)),
            details=lambda: F.struct(F.size(categories).alias("num_categories")),
            method=lambda: F.lit("function"),
        )

    return evaluator


def unregister(name: str) -> None:
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    _EVALUATORS.pop(name, None)


@contextmanager
def registered(name: str, evaluator: Evaluator) -> Iterator[None]:
    """Have an evaluator under ``name`` for the time of a block, whatever happens in it."""
    before = _EVALUATORS.get(name)
    _EVALUATORS[name] = evaluator
    try:
        yield
    finally:
        if before is None:
            _EVALUATORS.pop(name, None)
        else:
            _EVALUATORS[name] = before


def get_evaluator(name: str) -> Evaluator:
    if name not in _EVALUATORS:
        raise KeyError(f"no evaluator named {name!r}; known: {', '.join(_EVALUATORS)}")
    return _EVALUATORS[name]


def available_evaluators() -> list[str]:
    return list(_EVALUATORS)


def enabled_evaluators(settings: Settings) -> list[str]:
    """Registered evaluators that are not switched off, in registration order."""
    return [n for n in _EVALUATORS if settings.is_enabled(n)]


def evaluate(
    df: DataFrame,
    slots: Slot | Iterable[Slot] = (Slot(),),
    settings: Settings = Settings(),
    names: Iterable[str] | None = None,
    parts: Iterable[str] | None = None,
) -> DataFrame:
    """Score every row for every slot.

    One narrow pass: a candidate and its baseline are scored side by side in the same row,
    so nothing has to be regrouped afterwards. The Arrow functions of all evaluators and slots stand in
    one projection, so that a task runs one Python worker for them and not one for each, and the session sends
    them small batches (see ``session.bound_batches``). Disabled evaluators never enter the plan, and
    neither do result parts other than ``parts``.
    """
    bound_batches(df.sparkSession)
    given = df.columns
    slots = [slots] if isinstance(slots, Slot) else list(slots)
    if parts is not None:
        slots = [replace(slot, parts=tuple(parts)) for slot in slots]
    names = enabled_evaluators(settings) if names is None else list(names)
    together: dict[str, Column] = {}
    for slot in slots:
        for name in names:
            if own := _IN_PYTHON.get(get_evaluator(name)):
                df, columns = own(df, slot, settings.of(name))
                together |= columns
    df = df.withColumns(together) if together else df
    for slot in slots:
        for name in names:
            df = get_evaluator(name)(df, slot, settings.of(name))
    return without_shared(df, given)
