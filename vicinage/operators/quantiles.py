"""Exact quantiles by key without a task that holds a key's values, and gapless numbers.

Equal values are counted first, so ties cost one row.  The different values are
dealt by range over (key, value); a small table of rows by (range, key) gives
each range its start within the key, and a value's rank follows from its place
in its range.

Nulls are left out; NaN counts as the largest value.  A key without values has
no row; without keys an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _same(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"_s_{n}"))
    return out


def quantiles(df: DataFrame, keys: list[str], value: str | Column, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(keys, a column for each of ``wanted``): name to (q, ``disc`` or ``linear``).

    ``disc`` is the value at rank ceil(q n), ``linear`` lies between the values about (n - 1) q.
    """
    value = F.col(value) if isinstance(value, str) else value
    # Own names for the keys, so that none clashes with those used here.
    names, keys = keys, [f"_k{i}" for i in range(len(keys))]
    counted = df.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], value.alias("_v")).filter("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranged = written(counted.repartitionByRange(_parts(df.sparkSession), *keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    own = ranged.withColumn("_upto", F.sum("_c").over(Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    # A row a range and key that lies in it.
    held = ranged.groupBy("_part", *keys).agg(F.sum("_c").alias("_held"))
    key = Window.partitionBy(*keys)
    starts = held.select(F.col("_part").alias("_s__part"), *[F.col(k).alias(f"_s_{k}") for k in keys], F.coalesce(F.sum("_held").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_held").over(key).alias("_n"))
    ranked = own.join(starts, _same(["_part", *keys])).select(*keys, "_v", "_n", (F.col("_start") + F.col("_upto")).alias("_last"), (F.col("_start") + F.col("_upto") - F.col("_c")).alias("_before"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") < rank) & (rank <= F.col("_last")), F.col("_v")))

    found = {}
    for name, (q, kind) in wanted.items():
        if kind == "disc":
            found[f"{name}_low"] = at(F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("_n"))))
        else:
            place = F.floor(F.lit(float(q)) * (F.col("_n") - 1))
            found |= {f"{name}_low": at(place + 1), f"{name}_high": at(F.least(place + 2, F.col("_n")))}
    got = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[c.alias(f"_{n}") for n, c in found.items()]).filter("_n IS NOT NULL")
    out = []
    for name, (q, kind) in wanted.items():
        low = F.col(f"_{name}_low")
        if kind == "linear":
            place = F.lit(float(q)) * (F.col("_n") - 1)
            low = low + (F.col(f"_{name}_high") - low) * (place - F.floor(place))
        out.append(low.alias(name))
    return got.select(*[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], *out)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Rows with numbers from 0 without gaps in ``order``; ranges are numbered apart and start where the ones before end."""
    ranged = df.repartitionByRange(_parts(df.sparkSession), *order).sortWithinPartitions(*order)
    # The lower 33 bits of the id count the rows of a partition.
    ranged = written(ranged.withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    # A row a range.
    held = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_held"))
    starts = held.select("_part", F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")
