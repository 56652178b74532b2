"""Coherence, fluency and relevance: judge scores where present, else simple rules.

The texts of flags, notes and errors are fixed values.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import in_runs
from ..functions.expr import let
from ..functions.rounding import format_fixed
from ..functions.text import raw_sentences, words
from ..functions.words import strings
from ..schema import WARNING, flag
from ..settings import QualitySettings, Slot
from .results import add_result
from .shared import missing_text

NAME = "quality"
DIMENSIONS = ("coherence", "fluency", "relevance")

# The transition phrases counted for coherence.
TRANSITIONS = (
    "however", "therefore", "furthermore", "additionally", "moreover",
    "consequently", "in addition", "as a result", "for example",
    "in contrast", "meanwhile", "specifically", "notably",
)


def mean_words(n_words: Column, n_sentences: Column) -> Column:
    return n_words.cast("double") / F.greatest(n_sentences, F.lit(1)).cast("double")


def words_per_sentence(text: Column) -> Column:
    return mean_words(F.size(words(text)), F.size(raw_sentences(text)))


def fluency(mean_length: Column) -> Column:
    return (
        F.when(mean_length.between(10.0, 25.0), 4)
        .when(mean_length.between(5.0, 40.0), 3)
        .otherwise(2)
    )


def transition_count(text: Column) -> Column:
    """Distinct transition phrases that occur as substrings."""
    return let(
        F.lower(text),
        lambda low: F.size(
            F.filter(F.array(*[F.lit(t) for t in TRANSITIONS]), lambda t: F.contains(low, t))
        ),
    )


def coherence(transitions: Column) -> Column:
    return F.when(transitions >= 3, 4).when(transitions >= 1, 3).otherwise(2)


def prompt_overlap(text: Column, prompt: Column) -> Column:
    """Share of the distinct prompt words that the text also has."""
    return let(
        F.array_distinct(words(F.lower(prompt))),
        lambda wanted: F.size(F.array_intersect(wanted, words(F.lower(text)))).cast("double")
        / F.greatest(F.size(wanted), F.lit(1)).cast("double"),
    )


def relevance(text: Column, prompt: Column, overlap: Column | None = None) -> Column:
    """From the overlap of text and prompt, if it is known already."""
    given = F.coalesce(prompt, F.lit(""))
    return F.when(given == "", 3).otherwise(
        let(
            prompt_overlap(text, given) if overlap is None else overlap,
            lambda o: F.when(o > F.lit(0.4), 4).when(o > F.lit(0.2), 3).otherwise(2),
        )
    )


def word_counts(text: Column, prompt: Column) -> Column:
    """struct<words, transitions, overlap>: :func:`words`, :func:`transition_count` and
    :func:`prompt_overlap` of both texts, which are folded and cut once for all three."""

    def counts(text: str | None, prompt: str | None) -> tuple[int | None, int, float | None]:
        if text is None:
            return None, 0, None
        low = text.lower()
        found = low.split()
        wanted = set((prompt or "").lower().split())
        overlap = len(wanted.intersection(found)) / max(len(wanted), 1)
        return len(found), sum(t in low for t in TRANSITIONS), overlap

    def count_run(texts: pa.Array, prompts: pa.Array) -> pa.Array:
        rows = [counts(t, p) for t, p in zip(strings(texts), strings(prompts), strict=True)]
        types = {"words": pa.int32(), "transitions": pa.int32(), "overlap": pa.float64()}
        return pa.StructArray.from_arrays(
            [pa.array([row[i] for row in rows], t) for i, t in enumerate(types.values())], list(types)
        )

    def count(texts: pa.Array, prompts: pa.Array) -> pa.Array:
        return in_runs(count_run, texts, prompts)

    hook = F.arrow_udf(count, "struct<words:int,transitions:int,overlap:double>").asNondeterministic()
    return hook(text, prompt)


def quality_counts(
    df: DataFrame, slot: Slot, settings: QualitySettings
) -> tuple[DataFrame, dict[str, Column]]:
    """The rows, and the columns that are computed in Python and not there yet."""
    name = slot.temp("word_counts")
    if name in df.columns:
        return df, {}
    return df, {name: word_counts(F.col(slot.text), F.col(slot.prompt))}


def evaluate_quality(
    df: DataFrame, slot: Slot = Slot(), settings: QualitySettings = QualitySettings()
) -> DataFrame:
    text, prompt = F.col(slot.text), F.col(slot.prompt)
    use_judge = slot.judge is not None and not settings.use_heuristic
    judge = F.col(slot.judge) if use_judge else F.lit(None)

    df, in_python = quality_counts(df, slot, settings)
    df = df.withColumns(in_python) if in_python else df
    counts = F.col(slot.temp("word_counts"))
    known = slot.temp("n_pieces") in df.columns
    pieces = F.col(slot.temp("n_pieces")) if known else F.size(raw_sentences(text))
    df = df.withColumn(slot.temp("words_per_sentence"), mean_words(counts["words"], pieces))
    mean_length = F.col(slot.temp("words_per_sentence"))
    rules = {
        "coherence": coherence(counts["transitions"]),
        "fluency": fluency(mean_length),
        "relevance": relevance(text, prompt, counts["overlap"]),
    }
    def rule_rationale(dimension: str) -> Column:
        if dimension == "coherence":
            return F.lit("Heuristic: based on transition word density.")
        if dimension == "fluency":
            length = format_fixed(slot.temp("words_per_sentence"), 1)
            return F.concat(
                F.lit("Heuristic: avg sentence length = "), length, F.lit(" words.")
            )
        return F.when(
            F.coalesce(prompt, F.lit("")) != "", "Heuristic: keyword overlap with prompt."
        ).otherwise("Heuristic: no prompt provided for comparison.")

    def judged(dimension: str) -> Column:
        # A judge answer without this dimension counts as 3; judge values are truncated
        # to whole numbers and not range-checked.
        given = F.coalesce(judge[dimension].cast("int"), F.lit(3))
        return F.when(judge.isNotNull(), given).otherwise(rules[dimension])

    has_rationale = set()
    if use_judge:
        has_rationale = set(df.schema[slot.judge].dataType.fieldNames())

    def rationale(dimension: str) -> Column:
        if not use_judge:
            return rule_rationale(dimension)
        name = f"{dimension}_rationale"
        given = F.coalesce(judge[name], F.lit("")) if name in has_rationale else F.lit("")
        return F.when(judge.isNotNull(), given).otherwise(rule_rationale(dimension))

    df = df.withColumns(
        {
            slot.temp(d): judged(d) if use_judge else rules[d] for d in DIMENSIONS
        }
    )
    value = {d: F.col(slot.temp(d)) for d in DIMENSIONS}
    total = value["coherence"] + value["fluency"] + value["relevance"]
    method = (
        F.when(judge.isNotNull(), "judge").otherwise("heuristic")
        if use_judge
        else F.lit("heuristic")
    )

    def low() -> Column:
        scores = F.array(
            *[F.struct(F.lit(d).alias("dimension"), value[d].alias("value")) for d in DIMENSIONS]
        )
        return F.filter(scores, lambda x: x["value"] <= 2)

    def low_flag(d: str) -> Column:
        message = F.concat(
            F.lit(f"Low {d} score: "), value[d].cast("string"), F.lit("/5 — "), rationale(d)
        )
        return F.when(value[d] <= 2, flag(f"quality:{d}", message, WARNING))

    out_of_range = F.lit(False)
    for d in DIMENSIONS:
        out_of_range = out_of_range | ~value[d].between(1, 5)
    return add_result(
        df,
        slot,
        NAME,
        score=total.cast("double") / F.lit(15.0),
        error=missing_text(slot),
        sub_scores=lambda: {d: value[d].cast("double") / F.lit(5.0) for d in DIMENSIONS},
        passed=lambda: F.lit(True),
        categories=lambda: F.transform(
            low(), lambda x: F.concat(F.lit("quality:"), x["dimension"])
        ),
        flags=lambda: F.filter(
            F.array(*[low_flag(d) for d in DIMENSIONS]), lambda f: f.isNotNull()
        ),
        details=lambda: F.struct(
            *[value[d].alias(d) for d in DIMENSIONS],
            *[rationale(d).alias(f"{d}_rationale") for d in DIMENSIONS],
            method.alias("method"),
            out_of_range.alias("judge_out_of_range"),
        ),
        method=lambda: method,
    )
