"""What every evaluator adds to a row, and the long form of it.

An evaluator adds flat columns named ``<slot prefix><evaluator>_<part>``. They are flat
rather than one struct so that Catalyst drops every part nobody reads: a query that wants
only scores never builds flags, spans or details.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import empty_array
from ..functions.rounding import round_entries, round_exact
from ..schema import CRITICAL, no_flags, no_sub_scores
from ..settings import PARTS, Slot

def add_result(
    df: DataFrame,
    slot: Slot,
    name: str,
    *,
    score: Column,
    error: Column,
    sub_scores: Callable[[], dict[str, Column]],
    has_sub_scores: Column | None = None,
    passed: Callable[[], Column],
    categories: Callable[[], Column],
    flags: Callable[[], Column],
    details: Callable[[], Column],
    method: Callable[[], Column],
) -> DataFrame:
    """Add the wanted result columns. A row with an error scores 0 and raises no flag.

    The parts are functions, so an unwanted part costs nothing, not even planning time.
    """
    df = df.withColumns(
        {slot.temp(f"{name}_score"): score, slot.temp(f"{name}_error"): error}
    )
    failed = F.col(slot.temp(f"{name}_error")).isNotNull()
    out = {}
    if "sub_scores" in slot.parts:
        raw = sub_scores()
        df = df.withColumns({slot.temp(f"{name}_{k}"): v for k, v in raw.items()})
        rounded = F.create_map(
            *[x for k in raw for x in (F.lit(k), round_exact(slot.temp(f"{name}_{k}"), 4))]
        ) if raw else no_sub_scores()
        none = failed if has_sub_scores is None else failed | ~has_sub_scores
        out["sub_scores"] = F.when(none, no_sub_scores()).otherwise(rounded)
    if "score" in slot.parts:
        out["score"] = F.when(failed, F.lit(0.0)).otherwise(
            round_exact(slot.temp(f"{name}_score"), 4)
        )
    if "passed" in slot.parts:
        out["passed"] = failed | F.coalesce(passed(), F.lit(True))
    if "categories" in slot.parts:
        out["categories"] = F.when(failed, empty_array("string")).otherwise(categories())
    if "flags" in slot.parts:
        out["flags"] = F.when(failed, no_flags()).otherwise(flags())
    if "details" in slot.parts:
        out["details"] = details()
    if "method" in slot.parts:
        out["method"] = F.when(~failed, method())
    if "error" in slot.parts:
        out["error"] = F.col(slot.temp(f"{name}_error"))
    return df.withColumns({slot.out(f"{name}_{part}"): c for part, c in out.items()})


def passed_from_flags(flags: Column) -> Column:
    """A result passes when it has no critical flag."""
    return ~F.exists(flags, lambda f: f["severity"] == CRITICAL)


def result_rows(
    df: DataFrame,
    names: list[str],
    keys: list[str],
    slot: Slot = Slot(),
    parts: tuple[str, ...] = PARTS,
) -> DataFrame:
    """One row per (sample, evaluator): the stored form of the results.

    The rows come out of one in-row generator, so no shuffle is needed. ``details`` is
    JSON text because each evaluator has its own detail fields.
    """

    def record(order: int, name: str) -> Column:
        fields = [F.lit(order).alias("evaluator_order"), F.lit(name).alias("evaluator")]
        for part in parts:
            value = F.col(slot.out(f"{name}_{part}"))
            if part == "details":
                value = F.to_json(value)
            fields.append(value.alias(part))
        return F.struct(*fields)

    if not names:
        raise ValueError("result_rows needs at least one evaluator")
    return df.select(
        *keys, F.inline(F.array(*[record(i, n) for i, n in enumerate(names)]))
    )


def result_json(df: DataFrame, name: str, slot: Slot = Slot()) -> Column:
    """The serialised record of one evaluator, scores at four digits."""
    def col(part):
        return F.col(slot.out(f"{name}_{part}"))

    return F.to_json(
        F.struct(
            F.lit(name).alias("evaluator"),
            round_exact(slot.out(f"{name}_score"), 4).alias("score"),
            col("passed").alias("passed"),
            round_entries(slot.out(f"{name}_sub_scores"), 4).alias("sub_scores"),
            col("flags").alias("flags"),
            col("details").alias("details"),
        ),
        {"ignoreNullFields": "false"},
    )
