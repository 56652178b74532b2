"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst may inline a projected expression into its only consumer. When that consumer
    is the body of a higher-order function, the inlined expression would run once per
    element. An array argument is evaluated once per row, so the binding survives.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(values: Column) -> Column:
    """Mean of a double array; null when it is empty."""
    return let(values, lambda v: F.try_divide(array_sum(v), F.size(v).cast("double")))


def count_where(values: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(values, test))


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def elements(df: DataFrame, kept: list, array: Column | str, name: str, position: str = "_at") -> DataFrame:
    """``kept`` columns with one row per element of an array; without ``position`` it is dropped.

    From a plain generator the optimizer infers filters on the array, which it then pushes down
    as copies of whatever makes the array: an extraction would run two or three times a row. From an
    outer one it infers none, so the array is made once, and the empty ones go afterwards.
    """
    rows = df.select(*kept, F.posexplode_outer(array).alias(position, name)).where(F.col(position).isNotNull())
    return rows.drop(position) if position == "_at" else rows
