"""The promotion cascade over one row of scores and flags.

The texts of the reasons are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rounding import format_fixed

# Request defaults and the width of a regression that fails outright.
DEFAULT_MIN_SCORE = 0.8
REGRESSION_MARGIN = 0.05


def first_blocker(flags: Column, block_on_flags: Column) -> Column:
    """First flag, in flag order, that the request blocks on; null if none is."""
    return F.get(F.filter(flags, lambda f: F.array_contains(block_on_flags, f)), F.lit(0))


def reason_code(flags: Column, score: Column, baseline: Column, min_score: Column,
                blocker: Column) -> Column:
    """Which rule of the cascade applies. The order of the rules is the meaning."""
    return (
        F.when(blocker.isNotNull(), "1")
        .when(score < min_score, "2")
        .when(score < baseline - F.lit(REGRESSION_MARGIN), "3a")
        .when(score < baseline, "3b")
        .when(F.size(flags) > 0, "4")
        .when(baseline.isNotNull(), "5a")
        .otherwise("5b")
    )


def decision_of(code: Column) -> Column:
    return (
        F.when(code.isin("1", "2", "3a"), "fail")
        .when(code.isin("3b", "4"), "human_review")
        .otherwise("pass")
    )


def reason_of(code: Column, flags: Column, score: Column, baseline: Column, min_score: Column,
              blocker: Column) -> Column:
    ours, theirs = format_fixed(score, 2), format_fixed(baseline, 2)
    return (
        F.when(code == "1", F.concat(F.lit("Blocked on critical flag: "), blocker))
        .when(
            code == "2",
            F.concat(
                F.lit("Aggregate score "), ours, F.lit(" is below minimum threshold "),
                format_fixed(min_score, 2),
            ),
        )
        .when(
            code == "3a",
            F.concat(
                F.lit("Regression detected: Candidate ("), ours,
                F.lit(") is significantly worse than Baseline ("), theirs, F.lit(")"),
            ),
        )
        .when(
            code == "3b",
            F.concat(
                F.lit("Slight regression: Candidate ("), ours, F.lit(") vs Baseline ("), theirs,
                F.lit("). Requires review."),
            ),
        )
        .when(
            code == "4",
            F.concat(
                F.lit("Passed thresholds but flagged for review: "), F.array_join(flags, ", ")
            ),
        )
        .when(
            code == "5a",
            "Candidate meets or exceeds baseline aggregate score with no critical regressions.",
        )
        .otherwise("Candidate meets all promotion criteria.")
    )
