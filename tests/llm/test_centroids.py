"""Clustering against plain loops, the annulus against all comparisons, and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from vicinage.llm import centroids as ct
from vicinage.llm import queries


def plain(rows, k, rounds, components, scale=1024):
    """(rows, centroids, comparisons are all made) of whole vectors (id, x)."""
    v = [(i, [math.floor(float(a) * scale) for a in x]) for i, x in rows if x is not None and len(x) == components and all(a is not None and math.isfinite(a) for a in x)]
    digest = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    c = [x for _, x in sorted(v, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c)) for _, x in v]

    for _ in range(rounds):
        own = assigned()
        for j in range(len(c)):
            mine = [x for (_, x), (_, m) in zip(v, own, strict=True) if m == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((str(i), m, d) for (i, _), (d, m) in zip(v, assigned(), strict=True)), c


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, x string, cluster string")


def test_clusters_equal_plain_loops_with_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * (1 + i % 3)).tolist()) for i in range(200)]
    rows += [(7, rows[7][1]), (None, [0.1, 0.2, 0.3, 0.4]), (300, None), (301, []), (302, [1.0]), (303, [1.0, None, 0.0, 0.0]), (304, [1.0, float("nan"), 0.0, 0.0]), (305, [1.0, float("inf"), 0.0, 0.0])]
    got, found = ct.cluster(vectors(spark, [(*r, "a", "b", "c") for r in rows]), 5, 4, components=4)
    want, centroids = plain(rows, 5, 4, 4)
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got.collect()) == want
    assert [r["centroid"] for r in found.orderBy("cluster").collect()] == centroids
    assert sum(r["members"] for r in found.collect()) == len(want)
    assert sum(r["inertia"] for r in found.collect()) == sum(d for *_, d in want)


def test_repeated_vectors_leave_centroids_without_members(spark):
    rows = [(i, [1.0, -0.5]) for i in range(6)]
    got, found = ct.cluster(vectors(spark, [(*r, "a", "b", "c") for r in rows]), 3, 2, components=2)
    assert {(r["cluster"], r["distance"]) for r in got.collect()} == {(0, 0)}
    assert sorted((r["cluster"], r["members"]) for r in found.collect()) == [(0, 6), (1, 0), (2, 0)]


def test_empty_table_and_components_that_do_not_fit(spark):
    got, found = ct.cluster(vectors(spark, []), components=2)
    assert got.count() == 0 and found.count() == 0
    with pytest.raises(Exception, match="a component is larger"):
        ct.whole_numbers(vectors(spark, [(1, [1e300, 0.0], "a", "b", "c")]), 2, 1024).collect()


@pytest.mark.parametrize("seed", range(5))
def test_annulus_finds_the_nearest_and_leaves_most_out(seed):
    rng = np.random.default_rng(seed)
    # Norms from small to large, with repeated centroids and vectors half way between two.
    c = np.vstack([rng.integers(-50, 50, (40, 3)) * rng.integers(1, 40, (40, 1)), [[4, 0, 0], [-4, 0, 0], [0, 4, 0], [0, 4, 0]]])
    x = np.vstack([rng.integers(-2000, 2000, (300, 3)), c[:20], [[0, 0, 0], [0, 8, 0], [2, 2, 0]], (c[:10] + c[10:20]) // 2])
    all_ = ((x[:, None] - c[None]) ** 2).sum(2)
    who, best, compared = ct.Annulus(c).search(x)
    assert (who == all_.argmin(1)).all() and (best == all_.min(1)).all()
    assert compared < all_.size * 0.6
    # Vectors about their centroids, as clusters are: few others have such norms.
    assert ct.Annulus(c).search(c[:40] + rng.integers(-3, 4, (40, 3)))[2] < 40 * len(c) / 4


def test_query_has_a_row_per_whole_vector(spark, sf_dir, same):
    same(queries.QUERIES["op12_annulus_clusters"], queries.ORACLE["op12_annulus_clusters"])
