"""Decimal rounding of binary doubles that looks at the exact value.

Spark's ``round`` and ``bround`` work on the shortest decimal text of a double, so 0.00015
(really 0.000149999...) goes up. Scores here are rounded as IEEE arithmetic defines it: the
nearest multiple of 10^-digits to the exact binary value, ties to even. The error term of
the scaling product is recovered with a Veltkamp split, so no decimal type is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let

_SPLITTER = "134217729.0D"  # 2^27 + 1
_LARGE = "1.0E11D"  # above this, doubles have no fourth decimal worth rounding


def round_sql(x: str, digits: int) -> str:
    """SQL text that rounds ``x``, a reference to a double, to at most 7 decimals."""
    scale = f"{10**digits}.0D"
    high = f"({_SPLITTER} * {x} - ({_SPLITTER} * {x} - {x}))"
    product = f"({x} * {scale})"
    error = f"(({high} * {scale} - {product}) + ({x} - {high}) * {scale})"
    whole = f"cast(floor({product}) AS double)"
    past_half = f"(({product} - {whole} - 0.5D) + {error})"
    up = f"({past_half} > 0 OR ({past_half} = 0 AND {whole} % 2.0D <> 0.0D))"
    return (
        f"CASE WHEN isnan({x}) OR abs({x}) > {_LARGE} THEN {x} "
        f"ELSE ({whole} + IF({up}, 1.0D, 0.0D)) / {scale} END"
    )


def round_exact(value: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` (at most 7) decimals by its exact binary value.

    A column name costs one SQL expression. Any other column is bound first, because the
    value is used many times.
    """
    if isinstance(value, str):
        return F.expr(round_sql(f"`{value}`", digits))
    scale = F.lit(float(10**digits))

    def rounded(x: Column) -> Column:
        carried = x * F.lit(134217729.0)
        high = carried - (carried - x)
        product = x * scale
        error = (high * scale - product) + (x - high) * scale
        whole = F.floor(product).cast("double")
        past_half = (product - whole - F.lit(0.5)) + error
        up = (past_half > 0) | ((past_half == 0) & (whole % F.lit(2.0) != F.lit(0.0)))
        nearest = (whole + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / scale
        return F.when(F.isnan(x) | (F.abs(x) > F.lit(1.0e11)), x).otherwise(nearest)

    return let(value.cast("double"), rounded)


def round_entries(values: Column | str, digits: int) -> Column:
    """Round every value of a map column, given by name."""
    return F.expr(f"transform_values(`{values}`, (k, v) -> {round_sql('v', digits)})")


def format_fixed(value: Column | str, digits: int) -> Column:
    """Fixed-point text with the rounding of :func:`round_exact`."""
    return F.format_string(f"%.{digits}f", round_exact(value, digits))
