"""Stored weights of cross-fitted ridges, and their replay without a fit.

Weights are rows (fold, columns, weights, fingerprint): the names of the columns
in order, the intercept and a weight for each, and the digest of all three.
Rows whose vector or target is not finite are left out; an empty table, or a fold
without weights, gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nulls, vectors
from . import models

SCHEMA = "fold long, columns array<string>, weights array<double>"


def _fingerprint() -> Column:
    # Exact text of a double; -0.0 and 0.0 differ.
    text = F.transform("weights", lambda w: w.cast("string"))
    return F.sha2(F.concat_ws("|", F.col("fold").cast("string"), F.concat_ws(",", "columns"), F.concat_ws(",", text)), 256)


def freeze(spark: SparkSession, by_fold: dict[int, np.ndarray], columns: list[str], alpha: float = 1.0) -> DataFrame:
    """Weights for every fold of a model trained on the others; ``by_fold`` are the moments of [1, columns, target]."""
    at = list(range(1, len(columns) + 1))
    got = [(fold, columns, [float(w) for w in models.fitted(by_fold, fold, at, len(columns) + 1, alpha)[: len(columns) + 1]]) for fold in sorted(by_fold)]
    return spark.createDataFrame(got, SCHEMA).withColumn("fingerprint", _fingerprint())


def replay(rows: DataFrame, frozen: DataFrame, x: str, columns: list[str], y: str) -> DataFrame:
    """(fold, rows, nrmse): root mean squared error over the target's root mean square, with weights as they are.

    ``columns`` names the entries of ``x``.  Weights of other columns or another
    order, and weights that do not have their fingerprint, are an error.
    """
    whole = F.when(F.col("columns") != F.array(*[F.lit(c) for c in columns]), F.raise_error("weights of other columns")).when(~F.col("fingerprint").eqNullSafe(_fingerprint()), F.raise_error("weights changed since they were stored")).otherwise(F.col("weights"))
    # One row a fold.
    kept = rows.filter(vectors.whole(F.col(x)) & nulls.finite(F.col(y))).join(F.broadcast(frozen.select("fold", whole.alias("_w"))), "fold")
    terms = F.zip_with(F.concat(F.array(F.lit(1.0)), F.col(x)), F.col("_w"), lambda a, w: a * w)
    off = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) - F.col(y)
    sums = kept.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(off * off).alias("_e"), F.avg(F.col(y) * F.col(y)).alias("_b"))
    return sums.select("fold", "rows", F.when(F.col("_b") > 0, F.sqrt(F.col("_e")) / F.sqrt(F.col("_b"))).alias("nrmse"))


def replayed(published: DataFrame, again: DataFrame, tolerance: float = 5e-8) -> DataFrame:
    """(fold, published, replayed, status): OK within ``tolerance``, relative or absolute; CHANGED, MISSING (not replayed) or UNKNOWN (not published)."""
    a, b = F.col("published"), F.col("replayed")
    both = published.select("fold", F.col("nrmse").alias("published"), F.lit(1).alias("_p")).join(again.select("fold", F.col("nrmse").alias("replayed"), F.lit(1).alias("_r")), "fold", "full_outer")
    near = F.coalesce(F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b))), F.lit(False)) | (a.isNull() & b.isNull())
    return both.select("fold", "published", "replayed", F.when(F.col("_r").isNull(), "MISSING").when(F.col("_p").isNull(), "UNKNOWN").when(near, "OK").otherwise("CHANGED").alias("status"))
