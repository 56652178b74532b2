"""Configured or documented extensions of the gate: weights, tiers, trends, levels.

None of these changes a decision. They read what the gate has stored or scored.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.text import words
from ..settings import Settings

# Configured evaluator weights.
DEFAULT_WEIGHTS = {
    "hallucination": 0.30, "factual_accuracy": 0.25, "content_safety": 0.25, "quality": 0.20,
}
# Configured rating tiers, (rating, max toxicity, max violations).
DEFAULT_TIERS = (("G", 0.1, 0), ("PG", 0.3, 1), ("PG-13", 0.6, 3), ("R", 1.0, 999))


def weighted_score(scores: Mapping[str, Column], weights: Mapping[str, float] = DEFAULT_WEIGHTS) -> Column:
    """Weighted mean over the given evaluators; their weights need not add up to one."""
    total = reduce(lambda a, b: a + b, [F.lit(weights[n]) * s for n, s in scores.items()], F.lit(0.0))
    return total / F.lit(sum(weights[n] for n in scores))


def rating_by_tiers(
    max_toxicity: Column, issues: Column, tiers: Sequence[tuple[str, float, int]] = DEFAULT_TIERS
) -> Column:
    """First tier, in order, that both signals fit; the last tier takes what is left."""
    listed = json.dumps([{"rating": r, "toxicity": t, "issues": n} for r, t, n in tiers])
    table = F.from_json(F.lit(listed), "array<struct<rating:string,toxicity:double,issues:int>>")
    fitting = F.filter(
        table, lambda t: (max_toxicity < t["toxicity"]) & (issues <= t["issues"])
    )
    return F.coalesce(F.get(fitting, F.lit(0))["rating"], F.lit(tiers[-1][0]))


def gold_overlap(text: Column, gold: Column) -> Column:
    """Share of the distinct words of the gold output that the text has."""
    return let(
        F.array_distinct(words(F.lower(gold))),
        lambda wanted: F.try_divide(
            F.size(F.array_intersect(wanted, words(F.lower(text)))).cast("double"),
            F.size(wanted).cast("double"),
        ),
    )


def rubric_check(text: Column, gold: Column, rubric: Mapping[str, Column]) -> Column:
    """array<struct<rule, passed>> of the boolean rules of a rubric, gold overlap included."""
    rules = {"gold_overlap": gold_overlap(text, gold) >= F.lit(0.5), **rubric}
    return F.array(
        *[F.struct(F.lit(n).alias("rule"), c.alias("passed")) for n, c in rules.items()]
    )


def run_metrics(runs: DataFrame) -> DataFrame:
    """Run counts, decision ratios and regressions by suite, with totals."""
    return (
        runs.rollup("suite_id")
        .agg(
            F.count("*").alias("runs"),
            F.count_if(F.col("decision") == "pass").alias("passes"),
            F.count_if(F.col("decision") == "fail").alias("failures"),
            F.count_if(F.col("decision") == "human_review").alias("reviews"),
            F.count_if(F.col("reason_code").isin("3a", "3b")).alias("regressions"),
        )
        .withColumn("pass_ratio", F.col("passes").cast("double") / F.col("runs").cast("double"))
    )


def metric_partials(results: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One mergeable row per suite and evaluator of ``suite_id, evaluator, score, baseline, error`` rows.

    Partials of days or batches can be stored, put together with a union, and reported by
    :func:`metric_report`. Scores are summed in units of their four decimals; their distribution
    is a KLL sketch. Rows with an error count as errors and nowhere else; without a baseline
    score there is no regression.
    """
    good = F.col("error").isNull() & F.col("score").isNotNull()
    worse = good & (F.col("score") < F.col("baseline") - F.lit(tolerance))
    return results.groupBy("suite_id", "evaluator").agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(good).alias("scored"),
        F.count_if(worse).alias("regressions"),
        F.coalesce(F.sum(F.when(good, F.round(F.col("score") * 10000).cast("long"))), F.lit(0)).alias("units"),
        F.kll_sketch_agg_double(F.when(good, F.col("score"))).alias("sketch"),
    )


def metric_report(partials: DataFrame, quantiles: Sequence[float] = (0.5, 0.05)) -> DataFrame:
    """Error rate, regressions, mean and quantiles by suite and metric, by each alone, and overall.

    ``level`` says what a row is about; in a total the other key is null. Only partials are grouped
    several ways, one short row each, never the results.
    """
    sums = ("results", "errors", "scored", "regressions", "units")
    merged = partials.groupingSets(
        [["suite_id", "evaluator"], ["suite_id"], ["evaluator"], []], "suite_id", "evaluator"
    ).agg(
        F.grouping_id().alias("grouping"), *[F.sum(c).alias(c) for c in sums],
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )
    level = F.element_at(
        F.array(*map(F.lit, ("suite and evaluator", "suite", "evaluator", "all"))), (F.col("grouping") + 1).cast("int")
    )
    some = F.col("scored") > 0
    return merged.select(
        level.alias("level"), "suite_id", "evaluator", "results", "errors", "scored", "regressions",
        (F.col("errors") / F.col("results")).alias("error_rate"),
        F.when(some, F.col("units") / (F.col("scored") * 10000.0)).alias("mean_score"),
        F.when(some, F.kll_sketch_get_n_double("sketch")).alias("sketched"),
        *[
            F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(f"p{round(q * 100):02d}")
            for q in quantiles
        ],
    )


def regression_trend(
    runs: DataFrame, version: str = "suite_version", rolling: int = 3, saved: str = "ingest_seq"
) -> DataFrame:
    """Mean score per suite and version, its change, and a rolling mean over versions.

    Versions stand in the order in which they were first saved, whatever their names. Runs
    are reduced to one row per (suite, version) first; the window sees only those.
    """
    units = F.round(F.col("aggregate_score") * 10000).cast("long")
    means = runs.groupBy("suite_id", version).agg(
        F.count("*").alias("runs"), F.sum(units).alias("units"), F.min(saved).alias("first_saved")
    ).withColumn(
        "mean_score", F.col("units").cast("double") / (F.col("runs").cast("double") * 10000.0)
    )
    order = Window.partitionBy("suite_id").orderBy("first_saved", version)
    return means.withColumns(
        {
            "change": F.col("mean_score") - F.lag("mean_score").over(order),
            "rolling_mean": F.avg("mean_score").over(order.rowsBetween(1 - rolling, 0)),
        }
    ).drop("units", "first_saved")


def critical_flags(flags: Column, settings: Settings = Settings()) -> Column:
    """The flag categories that the evaluators raise as critical under these settings."""
    personal = F.lit(settings.content_safety.pii_is_critical)
    return F.filter(
        flags,
        lambda f: f.startswith("toxicity:") | (f.startswith("pii:") & personal) | (f == "hallucination:contradiction"),
    )


def enforcement_level(reason_code: Column, any_critical: Column) -> Column:
    """hard_gate for blockers and critical flags, ticket for other failures, else monitor."""
    return (
        F.when((reason_code == "1") | any_critical, "hard_gate")
        .when(reason_code.isin("2", "3a", "3b"), "ticket")
        .otherwise("monitor")
    )


def regressed_dimensions(
    candidate: Mapping[str, Column], baseline: Mapping[str, Column]
) -> Column:
    """Names of the dimensions whose candidate score is below the baseline's."""
    return F.filter(
        F.array(*[F.when(candidate[n] < baseline[n], F.lit(n)) for n in candidate]),
        lambda n: n.isNotNull(),
    )
