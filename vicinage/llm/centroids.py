"""Centroid clustering in whole numbers, with an annulus search for the nearest centroid.

A vector takes part if it has the asked number of components, none null, NaN or
infinite; each component x becomes floor(scale * x).  From there on all is exact:
squared distances, sums and floored means are whole numbers, so every run, order
of rows and number of tasks gives the same centroids.

**Annulus search.** Centroids are sorted by norm.  The distance d from a vector
to the centroid whose norm is nearest to its own is an upper bound of its least
distance, and by the triangle inequality a centroid at least as near has a norm
between the vector's less d and the vector's plus d.  Both ends are found by
binary search, widened by more than rounding can move them, so that ties at the
border stay inside; the candidates between are compared exactly, by squared
distance and then by number, from the nearest norm outwards, and each nearer
one narrows the annulus.

A round sends one row a task and centroid to Spark, which adds them up; the
driver holds centroids only.  The vectors are written once, and no round changes
them, so a lost executor costs a reread.

Nulls: a null vector takes no part; a null id does, its digest counting as the
largest.  Repeated rows count as often as they stand there.  With fewer vectors
than centroids every one is a centroid; equal centroids share nothing, as the
smaller number takes all.  Empty tables give empty results.  Components whose
squared distances would not fit 64 bits are an error (64 of them: 2^27 in size).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Vectors that are compared at a time.
ROWS = 4096
#: Squared distances stay below this.
FITS = 1 << 62


def whole_numbers(vectors: DataFrame, components: int, scale: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x array<long>) of the vectors that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    most = math.isqrt(FITS // components) // 2
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fit = F.when(F.forall("x", lambda v: F.abs(v) * scale <= most), F.transform("x", lambda v: F.floor(v * scale).cast("long"))).otherwise(F.raise_error(F.lit(f"a component is larger than {most} / {scale}")))
    own = vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).filter((F.size("x") == components) & F.coalesce(sound, F.lit(False)))
    return own.select("id", fit.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id, in that order; a top-k, whatever the table."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


class Annulus:
    """Centroids by norm, and the nearest of them to each vector."""

    def __init__(self, centroids: np.ndarray):
        norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        #: Equal norms in order of number.
        self.number = np.argsort(norm, kind="stable")
        self.sorted, self.norm = centroids[self.number], norm[self.number]

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row of x, ties to the smaller number; and how many comparisons it took."""
        n, last = len(x), len(self.norm) - 1
        own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        at = np.minimum(np.searchsorted(self.norm, own), last)
        at -= (at > 0) & (np.abs(self.norm[np.maximum(at - 1, 0)] - own) < np.abs(self.norm[at] - own))
        best, who = self._squared(x, self.sorted[at]), self.number[at]
        # Norms and roots are off by a few units in the last place at most.
        bound = np.sqrt(best.astype(np.float64)) + 1e-9 * (1 + own + self.norm[at])
        low, high = np.searchsorted(self.norm, own - bound, "left"), np.searchsorted(self.norm, own + bound, "right")
        compared = n
        for step in range(1, last + 1):
            # Outwards from the nearest norm, so that the annulus narrows with each nearer centroid.
            for j in (at + step, at - step):
                i = np.flatnonzero((low <= j) & (j < high))
                i = i[np.abs(self.norm[j[i]] - own[i]) <= np.sqrt(best[i].astype(np.float64)) + 1e-9 * (1 + own[i] + self.norm[j[i]])]
                compared += len(i)
                d, c = self._squared(x[i], self.sorted[j[i]]), self.number[j[i]]
                nearer = (d < best[i]) | ((d == best[i]) & (c < who[i]))
                best[i[nearer]], who[i[nearer]] = d[nearer], c[nearer]
            if not ((low < at - step + 1) | (at + step < high)).any():
                break
        return who, best, compared

    @staticmethod
    def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return np.einsum("ij,ij->i", d, d)


def _blocks(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def _totals(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, i, total, members) of each component of the clusters that have members."""
    k, components = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, sums, members = Annulus(centroids), np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        most = 0
        for _, x in _blocks(batches, components):
            who, _, _ = near.search(x)
            order = np.argsort(who, kind="stable")
            first = np.flatnonzero(np.diff(who[order], prepend=-1))
            sums[who[order][first]] += np.add.reduceat(x[order], first, axis=0)
            members += np.bincount(who, minlength=k)
            most += len(x)
            if most > 1 << 34:
                raise OverflowError("too many vectors in one task")
        used = np.flatnonzero(members)
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(list(sums[used]), pa.list_(pa.int64())), pa.array(members[used])], names=["cluster", "sums", "members"])

    parts = vectors.mapInArrow(run, "cluster int, sums array<long>, members long")
    each = parts.select("cluster", F.posexplode("sums").alias("i", "v"), "members")
    # One row a centroid and component, whatever the number of vectors.
    return each.groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members")).collect()


def moved(centroids: np.ndarray, totals: list) -> np.ndarray:
    """Floored means of the members; a centroid without members stays."""
    out = centroids.copy()
    for r in totals:
        out[r["cluster"], r["i"]] = int(r["total"]) // r["members"]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, components: int = 64, scale: int = 1024, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((id, cluster, distance), (cluster, centroid, members, inertia)): every vector's final cluster, and the clusters.

    ``distance`` and ``inertia`` are squared; clusters without members have none.
    """
    spark = vectors.sparkSession
    kept = materialize(whole_numbers(vectors, components, scale, id_column, vector), "vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, centroid array<long>, members long, inertia long")
    for _ in range(rounds):
        centroids = moved(centroids, _totals(kept, centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Annulus(centroids)
        for ids, x in _blocks(batches, components):
            who, distance, _ = near.search(x)
            yield pa.record_batch([ids, pa.array(who.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    assigned = materialize(kept.mapInArrow(run, "id long, cluster int, distance long"), "clusters")
    # One row a centroid.
    named = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    sums = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("distance").alias("inertia"))
    return assigned, named.join(sums, "cluster", "left").select("cluster", "centroid", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("inertia", F.lit(0)).alias("inertia"))


def digest(centroid: str) -> Column:
    """Lowercase hex SHA-256 of a centroid's components, joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(centroid).cast("array<string>")), 256)
