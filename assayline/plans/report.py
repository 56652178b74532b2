"""Reports of a comparison: the CI verdict and the JSON document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS_MEAN = 0.5  # fixed value: mean score at which a model passes an evaluator
SCHEMA_VERSION = "1.0"

SUMMARY_FIELDS = (
    "mean_a", "mean_b", "std_a", "std_b", "winner", "t_statistic", "w_statistic", "p_value",
    "test", "mean_diff", "effect_size",
)


def all_passed(either_passed: Column) -> Column:
    """True when every evaluator has a passing model; true without evaluators."""
    return F.coalesce(F.bool_and(either_passed), F.lit(True))


def ci_verdict(comparison: DataFrame, by: Sequence[str]) -> DataFrame:
    passes_a, passes_b = F.col("mean_a") >= PASS_MEAN, F.col("mean_b") >= PASS_MEAN
    return comparison.groupBy(*by).agg(
        F.count("*").alias("evaluators"),
        F.count_if(passes_a).alias("a_passing"),
        F.count_if(passes_b).alias("b_passing"),
        all_passed(passes_a | passes_b).alias("passed"),
    )


def json_reports(
    comparison: DataFrame, overall: DataFrame, by: str, model_a: Column, model_b: Column,
    timestamp: Column,
) -> DataFrame:
    """One JSON document per suite: summary, overall winner and the CI block.

    Only the evaluators of a suite are gathered (a handful of rows). Per-sample details stay
    a table; :func:`write_reports` stores them beside the documents.
    """
    entry = F.struct(
        "evaluator_order",
        "evaluator",
        "num_samples",
        F.struct(*SUMMARY_FIELDS).alias("summary"),
        F.struct(
            (F.col("mean_a") >= PASS_MEAN).alias("model_a_pass"),
            (F.col("mean_b") >= PASS_MEAN).alias("model_b_pass"),
        ).alias("status"),
    )
    gathered = comparison.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    statuses = F.transform(F.col("e"), lambda x: x["status"])

    def keyed(part: str) -> Column:
        return F.map_from_arrays(
            F.transform("e", lambda x: x["evaluator"]), F.transform("e", lambda x: x[part])
        )

    document = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        model_a.alias("model_a"),
        model_b.alias("model_b"),
        F.get("e", F.lit(0))["num_samples"].alias("num_samples"),
        F.col("overall_winner"),
        timestamp.alias("timestamp"),
        keyed("summary").alias("summary"),
        F.struct(
            F.forall(statuses, lambda s: s["model_a_pass"] | s["model_b_pass"]).alias("passed"),
            keyed("status").alias("evaluator_status"),
        ).alias("ci"),
    )
    return gathered.join(overall, by).select(by, F.to_json(document).alias("report"))


def write_reports(reports: DataFrame, path: str, details: DataFrame | None = None) -> None:
    """Write the documents as JSON lines, and the per-sample details as a table of their own."""
    reports.select("report").write.mode("overwrite").text(f"{path}/summary")
    if details is not None:
        details.write.mode("overwrite").json(f"{path}/details")
