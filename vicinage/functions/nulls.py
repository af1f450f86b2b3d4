"""Guarded arithmetic and the three policies for missing numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(n: Column, d: Column) -> Column:
    """n / d where d > 0, else null."""
    return F.when(d > 0, n / d)


def finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def strict_mean(c: Column | str) -> Column:
    """The mean, or null if any member is not finite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count_if(~finite(c)) == 0, F.avg(c))


def optional_mean(c: Column) -> Column:
    """The mean of the finite members."""
    return F.avg(F.when(finite(c), c))


def ratio_status(n: Column, d: Column) -> Column:
    """EVALUABLE, NO_CONTRAST (0/0) or UNBOUNDED (positive over 0)."""
    return F.when(d > 0, "EVALUABLE").when(n > 0, "UNBOUNDED").otherwise("NO_CONTRAST")


def relative_status(base: Column, new: Column) -> Column:
    """Of a ratio new / base: a zero base cannot be evaluated, a zero numerator dominates."""
    return F.when(base == 0, F.when(new > 0, "BASE_ZERO_WORSE").otherwise("BASE_ZERO")).when(new == 0, "DOMINANCE").otherwise("EVALUABLE")


def close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
