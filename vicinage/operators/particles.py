"""Smoothed-particle operators on edge tables, with the published cubic spline kernel (Monaghan 1992).

Edges (a, b, dx, dy, distance) point from a to b with the nearest image's offset
x_a - x_b, self-edges kept; particles (id, density, vx, vy, pressure, mass).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("density", "vx", "vy", "pressure", "mass")
#: Smallest eigenvalue over the trace from which a neighbourhood has full rank.
RANK_EPS = 256 * 2.0**-52


def offsets(edges: DataFrame, points: DataFrame, period: float) -> DataFrame:
    """Edges (a, b, distance) with dx and dy of the nearest image, from points (id, x, y)."""
    p = points.select("id", "x", "y")
    both = edges.join(p.toDF("a", "ax", "ay"), "a").join(p.toDF("b", "bx", "by"), "b")
    near = lambda d: d - F.lit(period) * F.round(d / F.lit(period))
    return both.select("a", "b", near(F.col("ax") - F.col("bx")).alias("dx"), near(F.col("ay") - F.col("by")).alias("dy"), "distance")


def kernel(distance: Column, h: float) -> Column:
    """Cubic spline in two dimensions with support 2 h."""
    q = distance / h
    c = 10 / (7 * math.pi * h * h)
    return F.when(q < 1, c * (1 - 1.5 * q * q + 0.75 * q * q * q)).when(q < 2, c * 0.25 * (2 - q) * (2 - q) * (2 - q)).otherwise(0.0)


def slope(distance: Column, h: float) -> Column:
    """Derivative of the kernel over the distance, divided by it: the gradient is this times the offset (0 at 0)."""
    q = distance / h
    c = 10 / (7 * math.pi * h * h) / (h * h)
    return F.when(q < 1, c * (-3 + 2.25 * q)).when(q < 2, -0.75 * c * (2 - q) * (2 - q) / q).otherwise(0.0)


def rates(edges: DataFrame, state: DataFrame, h: float, viscosity: float) -> DataFrame:
    """(id, density_rate, pressure_x, pressure_y, viscous_x, viscous_y, total_x, total_y), particles without neighbours included.

    Edges that carry the states of both ends (``a_density``, ...) are not joined with ``state``.

    Density rate: -density times the divergence of the velocity.  Pressure: the
    symmetric pair form.  Viscosity: the pair form of Morris et al. (1997).
    """
    side = lambda s: state.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in STATE])
    e = edges.filter(F.col("a") != F.col("b"))
    if "a_density" not in e.columns:
        e = e.join(side("a"), "a").join(side("b"), "b")
    g = slope(F.col("distance"), h)
    vol = F.col("b_mass") / F.col("b_density")
    dvx, dvy = F.col("a_vx") - F.col("b_vx"), F.col("a_vy") - F.col("b_vy")
    press = -F.col("b_mass") * (F.col("a_pressure") / (F.col("a_density") * F.col("a_density")) + F.col("b_pressure") / (F.col("b_density") * F.col("b_density"))) * g
    visc = 2 * viscosity * F.col("b_mass") / F.col("b_density") * g
    sums = e.groupBy(F.col("a").alias("id")).agg(
        F.sum(F.col("a_density") * vol * (dvx * F.col("dx") + dvy * F.col("dy")) * g).alias("density_rate"),
        *[F.sum(press * F.col(d)).alias(f"pressure_{d[1]}") for d in ("dx", "dy")],
        F.sum(visc * dvx).alias("viscous_x"),
        F.sum(visc * dvy).alias("viscous_y"),
    )
    names = ("density_rate", "pressure_x", "pressure_y", "viscous_x", "viscous_y")
    out = state.select("id").join(sums, "id", "left").select("id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])
    return out.withColumn("total_x", F.col("pressure_x") + F.col("viscous_x")).withColumn("total_y", F.col("pressure_y") + F.col("viscous_y"))


def neighbourhood(edges: DataFrame, support: float) -> DataFrame:
    """(id, neighbours, distance_cv, moment0, first_moment, cxx, cxy, cyy, low, high, full_rank) of each particle's edges.

    Weights are (1 - distance / support) squared; self-edges count in
    ``moment0`` alone.  ``low`` and ``high`` are the eigenvalues of the weighted
    covariance of offsets.
    """
    w = (1 - F.col("distance") / support) * (1 - F.col("distance") / support)
    other = F.col("a") != F.col("b")
    m = lambda c: F.coalesce(F.sum(F.when(other, w * c)), F.lit(0.0))
    d = F.when(other, F.col("distance"))
    agg = edges.groupBy(F.col("a").alias("id")).agg(
        F.count_if(other).alias("neighbours"), (F.stddev_pop(d) / F.avg(d)).alias("distance_cv"), F.sum(w).alias("moment0"), m(F.col("dx")).alias("_x"), m(F.col("dy")).alias("_y"),
        m(F.col("dx") * F.col("dx")).alias("cxx"), m(F.col("dx") * F.col("dy")).alias("cxy"), m(F.col("dy") * F.col("dy")).alias("cyy"),
    )
    trace, gap = F.col("cxx") + F.col("cyy"), F.sqrt((F.col("cxx") - F.col("cyy")) * (F.col("cxx") - F.col("cyy")) + 4 * F.col("cxy") * F.col("cxy"))
    out = agg.withColumn("first_moment", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).withColumn("low", (trace - gap) / 2).withColumn("high", (trace + gap) / 2)
    return out.withColumn("full_rank", F.col("low") > RANK_EPS * F.greatest(F.lit(1.0), trace)).drop("_x", "_y")


def responses(scales: DataFrame, key: str, multipliers: list[float], value: str) -> DataFrame:
    """(key, features): per scale L, its step D from the scale before and D over the step of ln scale, from rows (key, scale, value).

    Values of L, D and G stand side by side for each scale, so names and values have one order.
    """
    wide = scales.groupBy(key).pivot("scale", multipliers).agg(F.first(value))
    level = [F.col(f"`{m}`") for m in multipliers]
    out = []
    for i in range(1, len(multipliers)):
        step = level[i] - level[i - 1]
        out += [level[i], step, step / math.log(multipliers[i] / multipliers[i - 1])]
    return wide.select(key, F.array(level[0], *out).alias("features"))


def admitted(checks: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, particles, each check over all its particles, admitted); a null check fails."""
    one = checks.groupBy(key).agg(F.count(F.lit(1)).alias("particles"), *[F.bool_and(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names])
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    return one.withColumn("admitted", every)
