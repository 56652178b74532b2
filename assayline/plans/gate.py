"""Gate requests: score candidate and baseline, decide, and shape the stored run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import empty_array
from ..operators.registry import enabled_evaluators, evaluate
from ..settings import Settings, Slot
from .decision import decision_of, first_blocker, reason_code, reason_of

CANDIDATE = Slot(text="candidate", prefix="candidate_", toxicity="candidate_toxicity")
BASELINE = Slot(text="baseline", prefix="baseline_", toxicity="baseline_toxicity")

GROUNDING_FLOOR = 0.5  # fixed value: below it the plain hallucination flag is added


def aggregate_score(scores: Sequence[Column]) -> Column:
    """Plain mean, added up in evaluator order; 0 without evaluators."""
    total = reduce(lambda a, b: a + b, scores, F.lit(0.0))
    return total / F.lit(float(max(len(scores), 1)))


def collect_flags(slot: Slot, names: Sequence[str]) -> Column:
    """Flag categories in evaluator order, then flag order; repeats are kept."""
    if not names:
        return empty_array("string")
    return F.concat(*[F.col(slot.out(f"{n}_categories")) for n in names])


def with_hallucination_flag(flags: Column, grounding_score: Column) -> Column:
    """Append ``hallucination`` when grounding is poor and the flag is not there yet."""
    missing = ~F.array_contains(flags, F.lit("hallucination"))
    return F.when(
        (grounding_score < F.lit(GROUNDING_FLOOR)) & missing,
        F.array_append(flags, F.lit("hallucination")),
    ).otherwise(flags)


def evaluator_method(df: DataFrame, slot: Slot, settings: Settings, names: Sequence[str]) -> Column:
    if "quality" not in names:
        return F.lit("Deterministic Only")
    method = F.col(slot.out("quality_method"))
    judge = settings.quality.model or "Gemini"  # fixed value: label of an unnamed judge
    return (
        F.when(method == "judge", f"Deterministic + {judge} Judge")
        .when(method == "heuristic", "Deterministic + Heuristic Fallback")
        .otherwise("Deterministic Only")
    )


def decide(
    requests: DataFrame,
    settings: Settings = Settings(),
    candidate: Slot = CANDIDATE,
    baseline: Slot = BASELINE,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Add scores, flags and the decision to every request.

    Needs ``candidate``, ``baseline`` (null when there is none), ``prompt``, ``source``,
    the toxicity maps, ``min_score`` and ``block_on_flags``. Both texts of a request are in
    its row, so the whole gate is one narrow stage.
    """
    names = enabled_evaluators(settings) if names is None else list(names)
    slots = (
        replace(candidate, parts=("score", "categories", "method")),
        replace(baseline, parts=("score",)),
    )
    scored = evaluate(requests, slots, settings, names)

    def scores(slot: Slot) -> list[Column]:
        return [F.col(slot.out(f"{n}_score")) for n in names]

    flags = collect_flags(candidate, names)
    if "hallucination" in names:
        flags = with_hallucination_flag(flags, F.col(candidate.out("hallucination_score")))
    subscores = (
        F.create_map(*[x for n in names for x in (F.lit(n), F.col(candidate.out(f"{n}_score")))])
        if names
        else F.create_map().cast("map<string,double>")
    )
    out = scored.withColumns(
        {
            "aggregate_score": aggregate_score(scores(candidate)),
            "baseline_aggregate_score": F.when(
                F.col(baseline.text).isNotNull(), aggregate_score(scores(baseline))
            ),
            "subscores": subscores,
            "flags": flags,
            "evaluator_method": evaluator_method(scored, candidate, settings, names),
        }
    )
    return with_decision(out)


def with_decision(df: DataFrame) -> DataFrame:
    """Add decision, reason_code and reason from scores, flags and thresholds."""
    flags, score = F.col("flags"), F.col("aggregate_score")
    base, floor = F.col("baseline_aggregate_score"), F.col("min_score")
    df = df.withColumn("blocker", first_blocker(flags, F.col("block_on_flags")))
    blocker = F.col("blocker")
    df = df.withColumn("reason_code", reason_code(flags, score, base, floor, blocker))
    code = F.col("reason_code")
    return df.withColumns(
        {
            "decision": decision_of(code),
            "reason": reason_of(code, flags, score, base, floor, blocker),
        }
    )


RESULT_COLUMNS = (
    "aggregate_score", "subscores", "flags", "decision", "reason", "reason_code",
    "evaluator_method",
)


def redacted(df: DataFrame) -> DataFrame:
    """Keep prompts and texts only where the request asks for it; mark the others."""
    keep = F.col("store_full_payloads")
    return df.withColumns(
        {
            "input": F.when(keep, F.struct("prompt", "source")),
            "candidate_output": F.when(keep, F.col("candidate")),
            "baseline_output": F.when(keep, F.col("baseline")),
            "input_redacted": F.when(~keep, F.lit(True)),
            "output_redacted": F.when(~keep, F.lit(True)),
        }
    )


RUN_COLUMNS = (
    "run_id", "status", "created_at", "suite_id", "task_type", "candidate_id", "baseline_id",
    *RESULT_COLUMNS, "metadata", "version_metadata", "input", "candidate_output",
    "baseline_output", "input_redacted", "output_redacted",
)


def run_records(decided: DataFrame) -> DataFrame:
    """The stored form of decided requests (see ``sources.requests`` for the inputs).

    ``created_at`` is the UTC text of the job's start unless the rows bring their own.
    """
    if "created_at" not in decided.columns:
        now = F.date_format(
            F.convert_timezone(
                F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
            ),
            "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
        )
        decided = decided.withColumn("created_at", now)
    return redacted(decided.withColumn("status", F.lit("completed"))).select(*RUN_COLUMNS)
