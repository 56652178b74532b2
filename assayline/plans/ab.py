"""Paired comparison of two models.

The scores of a suite are first folded into a histogram over |difference|. Scores have four
decimals, so however many samples a suite holds, its histogram stays at a few ten thousand
rows at most. Ranks, ties and moments are all read off the histogram: no suite is ever
sorted or collected whole, and a suite with a third of all samples costs no more than
another. Moments are sums of whole 1e-4 units, which makes them independent of the order
and the partitioning of the rows.

Scores of any other kind, raw doubles, give a histogram as long as the suite. ``raw_statistics``
ranks it in parts: differences fall into buckets by their binary logarithm, ``OCTAVE`` to a
doubling, a window ranks within a bucket, and the offsets of the buckets come from one more
aggregate. Equal differences share a bucket, so ties never cross a border.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Context, Decimal
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import round_exact
from ..functions.stats import paired_p_value
from ..settings import Slot

T_TEST_MIN = 30  # fixed value: sample size from which the t-test is used
SPREAD_FLOOR = 1e-10  # fixed value: least divisor of the effect size
_UNIT = 10_000.0
OCTAVE = 1024  # buckets of raw differences from one power of two to the next
_EXACT = "decimal(38,18)"


def paired_scores(
    df: DataFrame, names: Sequence[str], keys: Sequence[str], a: Slot, b: Slot, errors: bool = False
) -> DataFrame:
    """One row per (sample, evaluator) with both scores, without a shuffle; with both ``errors``, if asked."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("evaluator_order"),
                F.lit(n).alias("evaluator"),
                F.col(a.out(f"{n}_score")).alias("score_a"),
                F.col(b.out(f"{n}_score")).alias("score_b"),
                *([F.col(x.out(f"{n}_error")).alias(f"error_{y}") for x, y in ((a, "a"), (b, "b"))] if errors else ()),
            )
            for i, n in enumerate(names)
        ]
    )
    return df.select(*keys, F.inline(rows))


def pair_outputs(outputs: DataFrame, suite: str = "suite_id", index: str = "sample_index",
                 slot: str = "slot", values: Sequence[str] = ("generated",)) -> DataFrame:
    """Positional zip of the outputs of slots 'a' and 'b', unmatched positions kept.

    The join key is unique per side, so it spreads evenly however large a suite is.
    """
    def side(which: str) -> DataFrame:
        return outputs.filter(F.col(slot) == which).select(
            suite, index, *[F.col(v).alias(f"{v}_{which}") for v in values],
            F.lit(True).alias(f"has_{which}"),
        )

    return side("a").join(side("b"), [suite, index], "full_outer").withColumn(
        "paired", F.col("has_a").isNotNull() & F.col("has_b").isNotNull()
    ).drop("has_a", "has_b")


def _histogram(pairs: DataFrame, by: list[str]) -> DataFrame:
    units_a = F.round(F.col("score_a") * _UNIT).cast("long")
    units_b = F.round(F.col("score_b") * _UNIT).cast("long")
    rows = pairs.select(
        *by,
        units_a.alias("ua"),
        units_b.alias("ub"),
        # The difference of the doubles themselves decides what is zero and what is tied.
        (F.col("score_a") - F.col("score_b")).alias("d"),
    ).withColumns({"distance": F.abs("d"), "ud": F.col("ua") - F.col("ub")})
    histogram = rows.groupBy(*by, "distance").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("d") > 0).alias("n_plus"),
        F.count_if(F.col("d") < 0).alias("n_minus"),
        *[
            total
            for u in ("ua", "ub", "ud")
            for total in (
                F.sum(u).alias(f"{u}_sum"),
                F.sum(F.col(u) * F.col(u)).alias(f"{u}_squares"),
            )
        ],
    )
    # Always true, but it reads every column: where a plan uses a comparison twice, both uses then need the same
    # histogram and share its shuffle, or all scores would be computed once for each.
    read = [F.col(c) >= 0 for c in histogram.columns if c.endswith(("_plus", "_minus", "_sum", "_squares"))]
    return histogram.where(reduce(or_, read, F.col("n") > 0))


def _spread(u: str, sample: bool = False) -> Column:
    """Standard deviation from whole-number moments (population unless ``sample``)."""
    n = F.col("n").cast("decimal(19,0)")
    total = F.col(f"{u}_sum").cast("decimal(19,0)")
    scatter = (n * F.col(f"{u}_squares").cast("decimal(19,0)") - total * total).cast("double")
    n = F.col("n").cast("double")
    divisor = F.sqrt(n * (n - 1.0)) if sample else n
    return F.try_divide(F.sqrt(F.greatest(scatter, F.lit(0.0))), divisor * F.lit(_UNIT))


def _mean(u: str) -> Column:
    return F.col(f"{u}_sum").cast("double") / (F.col("n").cast("double") * F.lit(_UNIT))


def paired_statistics(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments and test statistics per group of ``by``, from score_a and score_b."""
    by = list(by)
    histogram = _histogram(pairs, by)
    nonzero = F.col("n_plus") + F.col("n_minus")
    upto = Window.partitionBy(*by).orderBy("distance").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = histogram.withColumn("ties", nonzero).withColumn(
        "rank", F.sum("ties").over(upto) - (F.col("ties") - 1) / F.lit(2.0)
    )
    moments = [f"{u}_{m}" for u in ("ua", "ub", "ud") for m in ("sum", "squares")]
    ties = F.col("ties").cast("double")
    stats = ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("ties").alias("n_nonzero"),
        F.sum(F.col("n_plus") * F.col("rank")).alias("rank_plus"),
        F.sum(F.col("n_minus") * F.col("rank")).alias("rank_minus"),
        F.sum(ties * ties * ties - ties).alias("tie_term"),
        *[F.sum(m).alias(m) for m in moments],
    )
    stats = stats.select(
        *by,
        "n",
        "n_nonzero",
        "rank_plus",
        "rank_minus",
        "tie_term",
        _mean("ua").alias("mean_a"),
        _mean("ub").alias("mean_b"),
        _spread("ua").alias("std_a"),
        _spread("ub").alias("std_b"),
        _mean("ud").alias("mean_diff"),
        _spread("ud").alias("std_diff"),
        _spread("ud", sample=True).alias("sample_std_diff"),
    )
    return _with_tests(stats)


def _with_tests(stats: DataFrame) -> DataFrame:
    error = F.col("sample_std_diff") / F.sqrt(F.col("n").cast("double"))
    nan, infinity = F.lit(float("nan")), F.lit(float("inf"))
    t = F.coalesce(
        F.try_divide(F.col("mean_diff"), error),
        F.when(F.col("mean_diff") > 0, infinity).when(F.col("mean_diff") < 0, -infinity),
        nan,
    )
    return stats.withColumns(
        {
            "is_t_test": F.col("n") >= T_TEST_MIN,
            "t": t,
            "w": F.least("rank_plus", "rank_minus"),
            "effect_size": F.col("mean_diff") / F.greatest("std_diff", F.lit(SPREAD_FLOOR)),
        }
    )


def _same(left: str, right: str, by: Sequence[str]) -> list[Column]:
    return [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in by]


def _exact_spread(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from decimal moments, one call per batch of groups."""
    context = Context(prec=100)

    def spread(count, first, second) -> float:
        scatter = context.subtract(context.multiply(Decimal(int(count)), second), context.multiply(first, first))
        return float(context.sqrt(max(scatter, Decimal(0)))) / float(count)

    @F.pandas_udf("double")
    def spreads(n: pd.Series, total: pd.Series, squares: pd.Series) -> pd.Series:
        return pd.Series([spread(*x) for x in zip(n, total, squares, strict=True)], dtype="float64")

    return spreads(n, total, squares)


def raw_statistics(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """What :func:`paired_statistics` gives, for scores that are not rounded (up to 1e9 in size).

    Ranks are exact; sums are decimals with 18 places, so they do not depend on the order of rows.
    No window holds more than the distinct differences of a bucket of a group.
    """
    by = list(by)

    def total(x: Column) -> Column:
        return F.sum(x.cast(_EXACT))

    a, b = F.col("score_a"), F.col("score_b")
    rows = pairs.select(*by, a, b, (a - b).alias("d")).withColumn("distance", F.abs("d"))
    histogram = rows.groupBy(*by, "distance").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("n_plus"),
        F.count_if(F.col("d") < 0).alias("n_minus"), total(F.col("d")).alias("d_sum"),
        total(a).alias("a_sum"), total(a * a).alias("a_squares"), total(b).alias("b_sum"), total(b * b).alias("b_squares"),
    ).withColumn(
        "bucket", F.when(F.col("distance") > 0, F.floor(F.log2("distance") * OCTAVE))
    ).withColumn("ties", F.col("n_plus") + F.col("n_minus"))
    sums = ("n", "d_sum", "a_sum", "a_squares", "b_sum", "b_squares")
    totals = histogram.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]).withColumn(
        "mean_diff", F.col("d_sum").cast("double") / F.col("n")
    )
    buckets = histogram.where("ties > 0").groupBy(*by, "bucket").agg(F.sum("ties").alias("held"))
    below = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("below", F.coalesce(F.sum("held").over(below), F.lit(0)))
    within = Window.partitionBy(*by, "bucket").orderBy("distance").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = histogram.withColumn("upto", F.sum("ties").over(within))
    # rows without a difference have no bucket and no rank
    ranked = (
        placed.alias("h").join(offsets.alias("o"), [*_same("h", "o", by), F.col("h.bucket") == F.col("o.bucket")], "left")
        .join(totals.alias("t"), _same("h", "t", by))
    )
    # twice the mean rank of equal differences, a whole number
    twice = 2 * (F.col("o.below") + F.col("h.upto")) - F.col("h.ties") + 1
    whole = lambda c: c.cast("decimal(19,0)")
    mean, distance = F.col("t.mean_diff"), F.col("h.distance")
    zeros = F.col("h.n") - F.col("h.ties")
    scatter = (
        F.col("h.n_plus") * F.pow(distance - mean, F.lit(2)) + F.col("h.n_minus") * F.pow(distance + mean, F.lit(2))
        + zeros * mean * mean
    )
    ties = whole(F.col("h.ties"))
    parts = ranked.groupBy(*[F.col(f"h.`{c}`").alias(c) for c in by]).agg(
        F.sum("h.ties").alias("n_nonzero"),
        (F.coalesce(F.sum(whole(F.col("h.n_plus")) * whole(twice)), F.lit(0)).cast("double") / 2).alias("rank_plus"),
        (F.coalesce(F.sum(whole(F.col("h.n_minus")) * whole(twice)), F.lit(0)).cast("double") / 2).alias("rank_minus"),
        F.sum(F.pow(ties.cast("double"), F.lit(3)) - ties.cast("double")).alias("tie_term"),
        total(scatter).cast("double").alias("scatter"),
    )
    n = F.col("t.n").cast("double")
    stats = totals.alias("t").join(parts.alias("p"), _same("t", "p", by)).select(
        *[F.col(f"t.`{c}`").alias(c) for c in by],
        F.col("t.n").alias("n"), "n_nonzero", "rank_plus", "rank_minus", "tie_term",
        *[(F.col(f"t.{x}_sum").cast("double") / n).alias(f"mean_{x}") for x in "ab"],
        *[_exact_spread(F.col("t.n"), F.col(f"t.{x}_sum"), F.col(f"t.{x}_squares")).alias(f"std_{x}") for x in "ab"],
        F.col("t.mean_diff").alias("mean_diff"),
        F.sqrt(F.col("scatter") / n).alias("std_diff"),
        F.sqrt(F.try_divide(F.col("scatter"), n - 1)).alias("sample_std_diff"),
    )
    return _with_tests(stats)


def compare(pairs: DataFrame, by: Sequence[str], alpha: float = 0.05, raw: bool = False) -> DataFrame:
    """The full comparison per group of ``by``: statistics, p-value and winner.

    Evaluator scores have four decimals; ``raw`` is for scores of any other kind.
    """
    stats = raw_statistics(pairs, by) if raw else paired_statistics(pairs, by)
    use_t, nonzero = F.col("is_t_test"), F.col("n_nonzero")
    p_value = paired_p_value(
        use_t, F.col("t"), (F.col("n") - 1).cast("double"), F.col("w"), nonzero,
        F.col("tie_term"),
    )
    # Undefined comes back from Python as null; it is reported as not-a-number.
    tested = stats.withColumn("p_", p_value).withColumn(
        "p", F.coalesce("p_", F.lit(float("nan")))
    )
    significant = ~F.isnan("p") & (F.col("p") < F.lit(alpha))
    return tested.select(
        *by,
        F.col("n").alias("num_samples"),
        *[round_exact(F.col(c), 4).alias(c) for c in ("mean_a", "mean_b", "std_a", "std_b")],
        F.when(use_t, 0).otherwise(1).alias("test"),
        F.when(use_t, "t")
        .when(nonzero < 2, "none")
        .when(F.col("tie_term") == 0, "wilcoxon_exact")
        .otherwise("wilcoxon_normal")
        .alias("method"),
        F.when(use_t, round_exact(F.col("t"), 6)).alias("t_statistic"),
        F.when(~use_t & (nonzero >= 2), F.col("w")).alias("w_statistic"),
        round_exact(F.col("p"), 6).alias("p_value"),
        round_exact(F.col("mean_diff"), 6).alias("mean_diff"),
        round_exact(F.col("effect_size"), 6).alias("effect_size"),
        F.when(significant, F.when(F.col("mean_diff") > 0, "model_a").otherwise("model_b"))
        .otherwise("tie")
        .alias("winner"),
    )


def overall_winner(comparison: DataFrame, by: Sequence[str], model_a: Column, model_b: Column) -> DataFrame:
    """Majority of the evaluators, named by model id; ``tie`` when even."""
    counted = comparison.groupBy(*by).agg(
        F.count_if(F.col("winner") == "model_a").alias("a_wins"),
        F.count_if(F.col("winner") == "model_b").alias("b_wins"),
    )
    return counted.withColumn(
        "overall_winner",
        F.when(F.col("a_wins") > F.col("b_wins"), model_a)
        .when(F.col("b_wins") > F.col("a_wins"), model_b)
        .otherwise("tie"),
    )
