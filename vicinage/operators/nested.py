"""Nested selection of predictors: no row of a held-out fold touches a loss that chooses for it.

For the outer fold f and each inner fold v, predictors are trained on all folds
but these two and tested on v; the one with the least mean loss over the inner
folds is then trained on all folds but f and tested on f.  All trained sets come
from parts that one pass computes by fold: the nearest rows of each training
fold are merged over the folds of a set, and moment matrices, case energies and
means are added up.

A loss is the mean over families of the root of the family's error (mean over
cases of mean squared error of rows) over the root mean square of the training
targets (mean over families of mean over cases).  A predictor with a prediction
or a loss that is null, NaN or infinite is left out; ties go to the first by
``ORDER``.  Rows with a null key, a number or an entry of the vector that is not
finite are left out of everything.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nulls, vectors
from ..sources.scratch import written
from . import models
from .neighbours import legal_neighbours

NEAR = (5, 10, 20)
ORDER = (*(f"knn{k}" for k in NEAR), "ridge", "polynomial_ridge")
BASE = "mean"
_KEYS = ("row_id", "case_id", "lineage", "family", "fold", "seed")


def neighbour_means(points: DataFrame, folds: list[int]) -> DataFrame:
    """(row_id, without, knn5, knn10, knn20): means of the nearest rows outside a row's own fold and the fold ``without``; null with fewer rows."""
    keyed = points.select("row_id", "case_id", F.col("fold").alias("lineage"), "seed", "x")
    found = legal_neighbours(keyed, keyed, max(NEAR), by_lineage=True).join(points.select(F.col("row_id").alias("neighbour"), "y"), "neighbour")
    # At most max(NEAR) rows of each fold, put in order once for all sets of folds.
    near = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "case_id", "neighbour", "lineage", "y"))).alias("near"))

    def outside(fold: int) -> Column:
        kept = F.slice(F.filter("near", lambda x: x["lineage"] != F.lit(fold)), 1, max(NEAR))
        return F.struct(F.lit(fold).cast("long").alias("without"), F.transform(kept, lambda x: x["y"]).alias("ys"))

    sets = near.select(F.col("query").alias("row_id"), F.inline(F.array(*[outside(f) for f in folds]))).filter(F.size("ys") > 0)
    mean = lambda k: F.aggregate(F.slice("ys", 1, k), F.lit(0.0), lambda a, y: a + y) / k
    return sets.select("row_id", "without", *[F.when(F.size("ys") >= k, mean(k)).alias(f"knn{k}") for k in NEAR])


def ridge_fits(points: DataFrame, folds: list[int], positions: list[int], alpha: float) -> DataFrame:
    """(fold, without, ridge, polynomial_ridge): intercept and weights trained outside both folds; null where a solve fails."""
    z = F.concat(F.array(F.lit(1.0)), "x", models.quadratic("x", positions), F.array("y"))
    by = models.moments(points.select("fold", z.alias("z")), "fold", "z")
    terms = len(positions) * (len(positions) + 3) // 2
    rows = []
    for fold in folds:
        for without in folds:
            train = sum((m for k, m in by.items() if k not in (fold, without)), np.zeros((1, 1)))
            last = len(train) - 1
            fits = []
            for cols in (range(1, last - terms), range(last - terms, last)):
                try:
                    w = models.fit(train, list(cols), last, alpha)
                    fits.append([float(w[0]), *map(float, w[list(cols)])] if np.isfinite(w).all() else None)
                except (np.linalg.LinAlgError, IndexError, ZeroDivisionError, ValueError):
                    fits.append(None)
            rows.append((fold, without, *fits))
    return points.sparkSession.createDataFrame(rows, "fold long, without long, ridge array<double>, polynomial_ridge array<double>")


def training_targets(points: DataFrame, folds: list[int]) -> DataFrame:
    """(fold, without, rms, mean) of the targets outside both folds, cases and families alike."""
    case = points.groupBy("fold", "family", "case_id").agg(F.avg(F.col("y") * F.col("y")).alias("e"), F.avg("y").alias("m"))
    cell = case.groupBy("fold", "family").agg(F.sum("e").alias("e"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("n"))
    pairs = points.sparkSession.createDataFrame([(f, w, g) for f in folds for w in folds for g in folds if g not in (f, w)], "held long, without long, fold long")
    family = cell.join(pairs, "fold").groupBy("held", "without", "family").agg((F.sum("e") / F.sum("n")).alias("e"), (F.sum("m") / F.sum("n")).alias("m"))
    return family.groupBy(F.col("held").alias("fold"), "without").agg(F.sqrt(F.avg("e")).alias("rms"), F.avg("m").alias(BASE))


def _predicted(weights: str, terms: Column) -> Column:
    """Intercept first; null without weights."""
    return F.aggregate(F.zip_with(F.slice(weights, 2, 1 << 20), terms, lambda a, b: a * b), F.col(weights)[0], lambda a, v: a + v)


def losses(points: DataFrame, positions: list[int], alpha: float = 1.0) -> DataFrame:
    """(fold, without, a loss of each predictor): tested on ``fold``, trained outside it and ``without``; the same fold twice is the outer test."""
    clean = points.dropna(subset=list(_KEYS)).filter(vectors.whole(F.col("x")) & nulls.finite(F.col("y")))
    own = written(clean.select(*[F.col(k) if k == "family" else F.col(k).cast("long").alias(k) for k in _KEYS], "x", F.col("y").cast("double").alias("y")), "points")
    # Folds are a handful; families too.
    folds = sorted(r[0] for r in own.select("fold").distinct().collect())
    if not folds:
        return points.sparkSession.createDataFrame([], ", ".join(["fold long, without long", *[f"{c} double" for c in (*ORDER, BASE)]]))
    fits = ridge_fits(own, folds, positions, alpha).join(training_targets(own, folds), ["fold", "without"])
    tested = own.join(F.broadcast(fits), "fold").join(neighbour_means(own, folds), ["row_id", "without"], "left")
    tested = tested.withColumns({"ridge": _predicted("ridge", F.col("x")), "polynomial_ridge": _predicted("polynomial_ridge", models.quadratic("x", positions))})
    names = (*ORDER, BASE)
    errors = tested.select("fold", "without", "family", "case_id", "rms", *[((F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))).alias(c) for c in names])
    case = errors.groupBy("fold", "without", "family", "case_id").agg(F.first("rms").alias("rms"), *[nulls.strict_mean(F.col(c)).alias(c) for c in names])
    family = case.groupBy("fold", "without", "family").agg(F.first("rms").alias("rms"), *[nulls.strict_mean(F.col(c)).alias(c) for c in names])
    scaled = family.select("fold", "without", *[nulls.divide(F.sqrt(c), F.col("rms")).alias(c) for c in names])
    return scaled.groupBy("fold", "without").agg(*[nulls.strict_mean(F.col(c)).alias(c) for c in names])


def nested_selection(points: DataFrame, positions: list[int], alpha: float = 1.0) -> DataFrame:
    """(fold, best, status, inner_p..., outer_p..., oracle, base, improvement) of every outer fold.

    ``inner_p`` is the mean loss over the inner folds, null if one of them is;
    ``oracle`` the outer loss of the chosen predictor, ``base`` that of the training
    mean, ``improvement`` 1 - oracle / base.
    """
    every = written(losses(points, positions, alpha), "losses")
    inner = every.filter("fold <> without").groupBy(F.col("without").alias("fold")).agg(*[nulls.strict_mean(F.col(c)).alias(f"inner_{c}") for c in ORDER])
    outer = every.filter("fold = without").select("fold", *[F.col(c).alias(f"outer_{c}") for c in ORDER], F.col(BASE).alias("base"))
    ranked = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"inner_{c}").alias("loss"), F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(f"outer_{c}").alias("outer")) for i, c in enumerate(ORDER)]), lambda x: x["loss"].isNotNull()))
    best = F.try_element_at(ranked, F.lit(1))
    both = outer.join(inner, "fold", "left").withColumn("_best", best)
    return both.select(
        "fold", F.col("_best.name").alias("best"), F.when(F.col("_best").isNull(), "NOT_EVALUABLE").otherwise("SELECTED").alias("status"),
        *[f"inner_{c}" for c in ORDER], *[f"outer_{c}" for c in ORDER], F.col("_best.outer").alias("oracle"), "base", (1 - nulls.divide(F.col("_best.outer"), F.col("base"))).alias("improvement"),
    )
