"""Verified, sampled and replacing joins, and the radius join."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verified_join(left: DataFrame, right: DataFrame, keys: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(joined, audit): a 1:1 inner join, and counts of what is missing, repeated or differs in ``same`` columns."""
    a = left.withColumn("_l", F.lit(1))
    b = right.select(*keys, *[F.col(c).alias(f"_{c}") for c in same], *[c for c in right.columns if c not in {*keys, *same}], F.lit(1).alias("_r"))
    full = a.join(b, keys, "full_outer")
    bad = F.lit(False)
    for c in same:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    audit = full.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & bad).alias("differing"),
    )
    return a.join(b, keys).drop("_l", "_r", *[f"_{c}" for c in same]), audit


def hash_sample(rows: DataFrame, group: str, key: str, k: int, domain: str) -> DataFrame:
    """The first k rows of each group by the SHA-256 of domain, group and key, then key."""
    h = F.sha2(F.concat_ws("|", F.lit(domain), F.col(group).cast("string"), F.col(key).cast("string")), 256)
    w = Window.partitionBy(group).orderBy(h, key)
    return rows.withColumn("draw", F.row_number().over(w).cast("long")).filter(F.col("draw") <= k)


def reserve_replacement(primaries: DataFrame, reserves: DataFrame, group: str, key: str) -> DataFrame:
    """(group, failed, replacement): the ith failed primary takes the ith passing reserve; null when they run out."""
    w = Window.partitionBy(group).orderBy(key)
    need = primaries.filter("NOT passed").select(group, F.col(key).alias("failed"), F.row_number().over(w).alias("i"))
    have = reserves.filter("passed").select(group, F.col(key).alias("replacement"), F.row_number().over(w).alias("i"))
    return need.join(have, [group, "i"], "left").drop("i")


def radius_join(points: DataFrame, radius: float, period: float, carry: Sequence[str] = ()) -> DataFrame:
    """(a, b, distance, dx, dy) of all pairs nearer than ``radius`` on a torus, self-pairs kept; points (id, x, y) in [0, period).

    ``dx`` and ``dy`` point to a from the nearest image of b; columns to ``carry``
    follow as ``a_...`` and ``b_...``, so nothing has to be joined to the pairs.
    Points are dealt to a grid of cells no smaller than half the radius (1,024 a
    side at most), and each meets the 5 x 5 cells around it, every cell once, so no
    pair comes twice and all pairs of one a are made by one task.
    """
    cells = max(1, min(1024, int(2 * period // radius)))
    side = period / cells
    reach = math.ceil(radius / side)
    cell = lambda c: F.least(F.floor(F.col(c) / side), F.lit(cells - 1)).cast("long")
    a = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), *[F.col(c).alias(f"a_{c}") for c in carry], cell("x").alias("cx"), cell("y").alias("cy"))
    steps = F.array(*[F.lit(i) for i in (range(-reach, reach + 1) if cells > 2 * reach else range(cells))])
    own = [f"b_{c}" for c in carry]
    near = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), *[F.col(c).alias(f"b_{c}") for c in carry], cell("x").alias("ox"), cell("y").alias("oy"))
    near = near.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("b", "bx", "by", *own, F.pmod(F.col("ox") + F.col("i"), F.lit(cells)).alias("cx"), F.pmod(F.col("oy") + F.col("j"), F.lit(cells)).alias("cy"))
    # Both ends lie in one period; Spark's round would take a decimal for each pair.
    near_image = lambda d: F.when(d >= period / 2, d - F.lit(period)).when(d <= -period / 2, d + F.lit(period)).otherwise(d)
    # Work lies in the pairs, not in the bytes read: a fixed number of tasks, and neither side broadcast.
    spark = points.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = a.repartition(tasks, "cx", "cy").hint("merge").join(near.repartition(tasks, "cx", "cy"), ["cx", "cy"]).withColumns({"dx": near_image(F.col("ax") - F.col("bx")), "dy": near_image(F.col("ay") - F.col("by"))})
    met = met.withColumn("distance", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).filter(F.col("distance") < radius)
    return met.select("a", "b", "distance", "dx", "dy", *[f"a_{c}" for c in carry], *own)
