"""Display forms of small results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def p_value_display(p_value: Column, n_boot: Column, *, at_most_one_draw: bool = False) -> Column:
    """Four decimals, never a literal zero: ``< 1/n_boot`` for a p of exactly zero.

    ``at_most_one_draw`` uses that form up to and including 1/n_boot, as the baseline report does.
    """
    step = F.lit(1.0) / n_boot
    tiny = p_value <= step if at_most_one_draw else p_value == 0.0
    return (
        F.when(p_value.isNull(), "n/a")
        .when(tiny, F.format_string("< %.4f", step))
        .otherwise(F.format_string("%.4f", p_value))
    )


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient, NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def four_decimals(value: Column) -> Column:
    """Scale, round half to even, scale back: the rounding of numeric array libraries."""
    return F.rint(value * 10000) / 10000
