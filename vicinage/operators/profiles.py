"""Column profiles: which columns repeat another, are a multiple of it, or have no spread.

Columns are compared by order-free fingerprints over (key, value), so a table
needs no sort and no pairs of columns are joined; two 64-bit fingerprints tell
columns apart.  A column's scale is its first value, by key, that is not 0;
columns equal after division by it are multiples of each other.

Keys name rows and must differ; null values equal null values.  -0.0 counts as
0.0, NaN as equal to NaN.  A column of zeros, nulls and NaN has no scale and is
nobody's multiple.  An empty table gives a row a column, with nothing finite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite
from .quantiles import quantiles


def _marks(keys: list[str], value: Column) -> Column:
    return F.struct(*[F.bit_xor(F.xxhash64(F.lit(seed), *keys, value.isNull(), value)) for seed in (0, 1)])


def profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(i, name, finite, nonfinite, constant, least, most, largest, duplicate_of, multiple_of, factor) of each column.

    ``duplicate_of``: the first column with the same values.  ``multiple_of``: the
    first one that is this one divided by ``factor``, if it is no duplicate.
    """
    own = df.select(*keys, *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in columns])
    solid = lambda c: finite(F.col(c)) & (F.col(c) != 0)
    scales = own.agg(*[F.min_by(F.when(solid(c), F.col(c)), F.when(solid(c), F.struct(*keys))).alias(f"_s_{c}") for c in columns])
    both = own.crossJoin(F.broadcast(scales))
    one = []
    for i, c in enumerate(columns):
        v, good = F.col(c), finite(F.col(c))
        inside = F.when(good, v)
        one.append(F.struct(
            F.lit(i).alias("i"), F.lit(c).alias("name"), F.count_if(good).alias("finite"), F.count_if(~good).alias("nonfinite"), (F.min(v) == F.max(v)).alias("constant"),
            F.min(inside).alias("least"), F.max(inside).alias("most"), F.max(F.abs(inside)).alias("largest"), F.first(F.col(f"_s_{c}")).alias("scale"),
            _marks(keys, v).alias("raw"), F.when(F.first(F.col(f"_s_{c}")).isNotNull(), _marks(keys, v / F.col(f"_s_{c}"))).alias("scaled"),
        ))
    long = both.agg(F.array(*one).alias("p")).select(F.inline("p"))
    # A row a column.
    long = long.withColumns({"_raw": F.min("i").over(Window.partitionBy("raw")), "_scaled": F.min("i").over(Window.partitionBy("scaled"))})
    first = long.select(F.col("i").alias("_i"), F.col("name").alias("_name"), F.col("scale").alias("_scale"))
    out = long.join(first.withColumnsRenamed({"_i": "_raw", "_name": "_dup"}).drop("_scale"), "_raw").join(first.withColumnsRenamed({"_i": "_scaled", "_name": "_mult"}), "_scaled")
    multiple = F.col("scaled").isNotNull() & (F.col("_scaled") < F.col("i")) & (F.col("_mult") != F.col("_dup"))
    return out.select(
        "i", "name", "finite", "nonfinite", "constant", "least", "most", "largest", F.when(F.col("_raw") < F.col("i"), F.col("_dup")).otherwise("").alias("duplicate_of"),
        F.when(multiple, F.col("_mult")).otherwise("").alias("multiple_of"), F.when(multiple, F.col("scale") / F.col("_scale")).alias("factor"),
    )


def flat_folds(df: DataFrame, fold: str, columns: list[str]) -> DataFrame:
    """(name, fold, iqr, divisor) of the rows outside each fold; a column without spread between its quartiles is divided by 1."""
    # A handful of folds.
    folds = df.select(F.col(fold).alias("_held")).distinct()
    long = df.select(F.col(fold).alias("_own"), F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])))
    trained = long.join(F.broadcast(folds), F.col("_own") != F.col("_held"))
    q = quantiles(trained, ["name", "_held"], "v", {"low": (0.25, "linear"), "high": (0.75, "linear")})
    iqr = F.col("high") - F.col("low")
    return q.select("name", F.col("_held").alias("fold"), iqr.alias("iqr"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("divisor"))
