"""Vector columns (arrays of double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def whole(x: Column) -> Column:
    """Whether a vector is not null and all its entries are finite; never null itself."""
    return x.isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def norm_sq(x: Column) -> Column:
    return total(F.transform(x, lambda v: v * v))


def diff_sq(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def angle_degrees(x: Column, y: Column, floor: float) -> Column:
    """Angle of two vectors; null unless both are longer than ``floor``."""
    a, b = F.sqrt(norm_sq(x)), F.sqrt(norm_sq(y))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / (a * b)))
    return F.when((a > floor) & (b > floor), F.degrees(F.acos(cosine)))


def eigen_2x2(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """Smaller and larger eigenvalue of a symmetric 2 x 2 matrix."""
    middle, half = (xx + yy) / 2, F.sqrt((xx - yy) * (xx - yy) / 4 + xy * xy)
    return middle - half, middle + half
