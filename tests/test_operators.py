import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vicinage.functions import nulls
from vicinage.operators import geometry, hierarchy, models, neighbours, stats
from vicinage.operators.neighbours import legal_neighbours
from vicinage.sources import tables

#: Metric fixtures as (family, lineage, rows of (n, b)) and the balanced ratio W(n) / W(b).
FIXTURES = {
    "S1": ([("F1", "l1", [(1, 1), (3, 1)]), ("F1", "l2", [(1, 1), (3, 1)])], 2),
    "S2": ([("F1", "l1", [(0, 0), (1, 1)]), ("F1", "l2", [(1, 1), (1, 1)])], 1),
    "S3": ([("F1", "l1", [(1, 0), (1, 1)]), ("F1", "l2", [(1, 1), (1, 1)])], 4 / 3),
    "S4": ([("F1", "l1", [(0, 0), (0, 0)]), ("F1", "l2", [(1, 1), (1, 1)])], 1),
    "S5": ([("F1", "l1", [(1, 0), (1, 0)])], None),
    "S6": ([("F1", "l1", [(1, 0), (1, 0)]), ("F1", "l2", [(1, 1), (1, 1)])], 2),
    "S7": ([("F1", "l1", [(1, 0)]), ("F2", "l2", [(1, 1)])], 2),
    "S8": ([("F1", "l1", [(0, 0), (0, 0)])], None),
    "S10": ([("F1", "l1", [(1, 2.0**-100)])], 2.0**100),
    "S11": ([("F1", "l1", [(9, 1)]), ("F1", "l2", [(1, 1)] * 3)], 5),
    "S12": ([("F1", "l1", [(9, 1)]), ("F2", "l2", [(1, 1)]), ("F2", "l3", [(1, 1)]), ("F2", "l4", [(1, 1)])], 5),
    "S13": ([("F1", "l1", [(100, 1)]), ("F1", "l2", [(1, 1)]), ("F1", "l3", [(1, 1)])], 34),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_balanced_ratio_fixtures(name, spark):
    cases, want = FIXTURES[name]
    rows = [(0, fam, lin, i, float(n), float(b)) for i, (fam, lin, parts) in enumerate(cases) for n, b in parts]
    w = hierarchy.balanced(spark.createDataFrame(rows, "fold long, family string, lineage string, case_id long, n double, b double"), "n", "b")
    got = w.select(nulls.divide(F.col("n"), F.col("b")), nulls.ratio_status(F.col("n"), F.col("b"))).first()
    assert got[0] == (pytest.approx(want) if want is not None else None)
    assert (got[1] == "EVALUABLE") == (want is not None)


def test_row_order_and_scale_do_not_matter(spark):
    rng = np.random.default_rng(1)
    rows = [(int(f), f"F{a}", int(f * 10 + a), int(f * 100 + a * 10 + c), float(rng.integers(1, 9))) for f in range(3) for a in range(2) for c in range(4)]
    df = lambda r: spark.createDataFrame(r, "fold long, family string, lineage long, case_id long, y double")
    w = hierarchy.balanced(df(rows), "y").first()[0]
    assert hierarchy.balanced(df(rows[::-1]), "y").first()[0] == pytest.approx(w)
    assert hierarchy.balanced(df([(*r[:4], 3 * r[4]) for r in rows]), "y").first()[0] == pytest.approx(3 * w)


def test_null_policies(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    got = df.agg(nulls.strict_mean(F.col("x")), nulls.optional_mean(F.col("x"))).first()
    assert got[0] is None and got[1] == 2.0


def test_statistics_on_clashing_names(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 5.0), ("a", 0.0, 0.0)], "n string, c double, w double")
    assert stats.gini(df, ["n"], "c").first()["gini"] == pytest.approx(1 / 2 - 1 / 12)
    assert stats.spearman(df, ["n"], "c", "w").first()["rho"] == pytest.approx(0.8)
    assert stats.weighted_quantile(df, ["n"], "c", "w", 0.5).first()["quantile"] == 3.0


def test_legal_neighbours_against_brute_force(spark, monkeypatch):
    from vicinage.operators import neighbours as nb

    monkeypatch.setattr(nb, "BLOCK", 16)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (60, 3)).astype(float)  # many ties
    rows = [(i, i // 2, i // 6, i // 6 % 3, x[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, case_id long, lineage long, seed long, x array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in legal_neighbours(df, df, 5).collect()}
    for i in range(60):
        legal = [j for j in range(60) if i // 2 != j // 2 and i // 6 != j // 6 and (i // 6 % 3 == 0 or i // 6 % 3 != j // 6 % 3)]
        want = sorted(legal, key=lambda j: (np.linalg.norm(x[i] - x[j]), j // 2, j))[:5]
        assert [got[i, k + 1] for k in range(5)] == want


def test_ridge_and_spectrum_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    y = x @ [1, -2, 0, 3] + rng.normal(size=80)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    beta, bias = models.ridge(df, "x", "y")
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(4), xc.T @ (y - y.mean()))
    assert np.allclose(beta, want) and bias == pytest.approx(y.mean() - x.mean(0) @ want)
    cov = geometry.covariance(df, "x")[2]
    assert np.allclose(cov, np.cov(x.T, bias=True))
    # Shrinkage by its definition, row by row; whitening makes the shrunk covariance the identity.
    z, n = x - x.mean(0), len(x)
    target = np.trace(cov) / 4 * np.eye(4)
    beta_sq = sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / n**2
    weight = min(1.0, beta_sq / ((cov - target) ** 2).sum())
    _, shrunk, got = geometry.shrinkage(df, "x")
    assert got == pytest.approx(weight) and np.allclose(shrunk, (1 - weight) * cov + weight * target)
    _, linear = geometry.transform(df, "x", "U3")
    assert np.allclose(linear.T @ shrunk @ linear, np.eye(4))


def test_sources(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_union([spark.range(2).withColumn("a", F.array(F.lit(1))), spark.range(1).withColumn("b", F.lit("x"))], path)
    back = tables.read_csv_strings(spark, path)
    assert set(back.columns) == {"id", "a", "b"} and back.count() == 3 and {t for _, t in back.dtypes} == {"string"}
    with pytest.raises(Exception, match="not a int"):
        spark.createDataFrame([("x",)], "s string").select(tables.strict(F.col("s"), "int")).collect()
    with pytest.raises(ValueError, match="want int"):
        from pyspark.sql.types import IntegerType, StructField, StructType

        tables.checked(spark.range(1), StructType([StructField("id", IntegerType())]))


def test_balanced_means_skip_nothing(spark):
    from vicinage.operators import hierarchy

    rows = [(0, "f", 1, 1, 1.0), (0, "f", 1, 2, 3.0), (0, "g", 2, 3, 5.0), (1, "f", 3, 4, None), (1, "f", 3, 4, 2.0), (1, "g", 4, 5, 7.0), (2, "f", 5, 6, float("nan")), (2, "g", 6, 7, 9.0)]
    df = spark.createDataFrame(rows, "fold int, family string, lineage int, case_id int, y double")
    by = {r["fold"]: r["y"] for r in hierarchy.balanced(df, "y", upto="fold").collect()}
    assert by == {0: 3.5, 1: None, 2: None}
    assert hierarchy.balanced(df, "y").first()["y"] is None and hierarchy.balanced(df.filter("fold = 0"), "y").first()["y"] == 3.5
    cells = hierarchy.cell_mean(df, "y")
    assert {(r["fold"], r["family"]): (r["y"], r["cases"]) for r in cells.collect()} == {(0, "f"): (2.0, 2), (0, "g"): (5.0, 1), (1, "f"): (None, 1), (1, "g"): (7.0, 1), (2, "f"): (None, 1), (2, "g"): (9.0, 1)}
    scopes = {(r["scope"], r["scope_id"]): r["y"] for r in hierarchy.scope_rows(cells, "y").collect()}
    assert scopes["FAMILY", "g"] == 7.0 and scopes["FAMILY", "f"] is None and scopes["FOLD", "0"] == 3.5 and scopes["OVERALL", "ALL"] is None
    assert hierarchy.balanced(df.limit(0), "y").first()["y"] is None and hierarchy.cell_mean(df.limit(0), "y").count() == 0


def test_neighbours_of_pruned_cells_equal_brute_force(spark, monkeypatch):
    from vicinage.operators import neighbours as nb

    monkeypatch.setattr(nb, "BLOCK", 8)
    visited = []
    pairs = nb.cell_pairs
    monkeypatch.setattr(nb, "cell_pairs", lambda *a: visited.append((len(a[0]), pairs(*a))) or visited[-1][1])
    rng = np.random.default_rng(5)
    n = 400
    centre = rng.normal(size=(25, 6)) * 50
    x = np.round(centre[np.arange(n) % 25] + rng.normal(size=(n, 6)), 1)
    x[:40] = x[0]  # a hot point with ties
    rows = [(i, i // 2, i // 3, i % 4, x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, case_id long, lineage long, seed long, x array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in legal_neighbours(df, df, 5).collect()}
    for i in range(n):
        legal = [j for j in range(n) if i // 2 != j // 2 and i // 3 != j // 3 and (i % 4 == 0 or i % 4 != j % 4)]
        want = sorted(legal, key=lambda j: (np.sqrt(((x[i] - x[j]) ** 2).sum()), j // 2, j))[:5]
        assert [got[i, r + 1] for r in range(5)] == want
    cells, (a, _) = visited[0]
    assert cells == 50 and len(a) < cells**2 / 4
    # Queries other than the training rows, some far away from all of them.
    far = spark.createDataFrame([(1000, 1000, 1000, 0, [1e3] * 6), (1001, 1001, 1001, 0, x[7].tolist())], df.schema)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in legal_neighbours(far, df, 2).collect()}
    for q, at in ((1000, np.full(6, 1e3)), (1001, x[7])):
        assert [got[q, 1], got[q, 2]] == sorted(range(n), key=lambda j: (np.sqrt(((at - x[j]) ** 2).sum()), j // 2, j))[:2]


def test_vectors_with_gaps_and_empty_tables(spark):
    schema = "row_id long, case_id long, lineage long, seed long, x array<double>"
    whole = [(i, i, i, 0, [float(i), 1.0]) for i in range(4)]
    gaps = [(10, 10, 10, 0, None), (11, 11, 11, 0, [None, 1.0]), (12, 12, 12, 0, [float("nan"), 0.0]), (13, None, 13, 0, [0.0, 0.0]), (None, 14, 14, 0, [0.0, 0.0])]
    df, clean = spark.createDataFrame(whole + gaps, schema), spark.createDataFrame(whole, schema)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(legal_neighbours(df, df, 2)) == rows(legal_neighbours(clean, clean, 2)) and len(rows(legal_neighbours(clean, clean, 9))) == 12
    assert legal_neighbours(clean.limit(0), clean, 2).count() == 0 == legal_neighbours(clean, clean.limit(0), 2).count()
    df = spark.createDataFrame(whole + gaps[:3], schema)  # the others have whole vectors
    y = F.col("row_id").cast("double").alias("y")
    a, b = models.ridge(df.select("x", y), "x", "y"), models.ridge(clean.select("x", y), "x", "y")
    assert np.allclose(a[0], b[0]) and a[1] == pytest.approx(b[1])
    none = clean.limit(0).select("x", y)
    beta, bias = models.ridge(none, "x", "y")
    assert len(beta) == 0 and np.isnan(bias) and clean.select(models.predict("x", beta, bias).alias("p")).filter("p IS NOT NULL").count() == 0
    z = df.select(F.lit(0).alias("k"), "x")
    assert np.allclose(models.moments(z, "k", "x")[0], models.moments(clean.select(F.lit(0).alias("k"), "x"), "k", "x")[0]) and models.moments(z.limit(0), "k", "x") == {}
    for kind in ("U0", "U1", "U2", "U3"):
        offset, linear = geometry.transform(df, "x", kind)
        assert np.allclose(linear, geometry.transform(clean, "x", kind)[1])
        shown = {r["row_id"]: r["x"] for r in geometry.applied(df, "x", offset, linear).collect()}
        assert shown[10] is shown[11] is shown[12] is None and np.allclose(shown[2], (np.array([2.0, 1.0]) - offset) @ linear)
        offset, linear = geometry.transform(none, "x", kind)
        assert not linear.size and geometry.applied(none, "x", offset, linear).count() == 0 and np.isnan(geometry.overlap(linear, linear)[1])


def test_drop_one_equals_the_mean_of_what_is_left(spark):
    rng = np.random.default_rng(7)
    rows = [(int(f), a, int(f * 100 + i * 10), int(f * 1000 + i * 100 + c), float(rng.integers(0, 9))) for f in range(3) for i, a in enumerate("ab"[: 1 + f % 2]) for c in range(1 + i) for _ in range(2)]
    rows += [(0, "a", 1, 1, 4.0), (0, "b", 2, 2, None), (0, "b", 2, 3, 1.0)]

    def balanced(left):
        for n in (4, 3, 2, 1, 0):
            held = {}
            for *key, v in left:
                held.setdefault(tuple(key[:n]), []).append(v)
            left = [(*k, None if None in v else sum(v) / len(v)) for k, v in held.items()]
        return left[0][0] if left else None

    for data in (rows, [r for r in rows if r[4] is not None], rows[:1]):
        df = spark.createDataFrame(data, "fold long, family string, lineage long, case_id long, y double")
        for n, level in enumerate(("fold", "family", "lineage", "case_id"), 1):
            want = {k: balanced([r for r in data if r[:n] != k]) for k in {r[:n] for r in data}}
            got = {tuple(r)[:-1]: r["without"] for r in hierarchy.drop_one(df, "y", level).collect()}
            assert got.keys() == want.keys()
            assert all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k]) for k in want)
    assert hierarchy.drop_one(df.limit(0), "y", "lineage").count() == 0


def test_groups_of_cells_keep_every_neighbour_and_meet_less(spark, monkeypatch):
    from vicinage.operators import neighbours as nb

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.2, (20, 3)) for c in rng.normal(0, 10, (20, 3))])
    rows = [(i, i // 2, i // 10, i % 3, list(map(float, v))) for i, v in enumerate(x)]
    p = spark.createDataFrame(rows, "row_id long, case_id long, lineage long, seed long, x array<double>")
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(nb, "FEW", 4)
    sent, met = [], nb._met
    monkeypatch.setattr(nb, "_met", lambda *a: (sent.append(len(a[2][0])), met(*a))[1])
    found = {}
    for wide in (7, 100, 10_000):
        monkeypatch.setattr(nb, "WIDE", wide)
        found[wide] = sorted(map(tuple, nb.legal_neighbours(p, p, 4).collect()))
    assert found[7] == found[100] == found[10_000] and len(found[7]) == 1600 and sent[-1] <= 25 < sent[1]
    for q, rank, n, d in found[7][:200]:
        near = sorted((float(np.sqrt(((x[q] - x[t]) ** 2).sum())), t // 2, t) for t in range(400) if t // 2 != q // 2 and t // 10 != q // 10 and (q % 3 == 0 or q % 3 != t % 3))
        assert n == near[rank - 1][2] and abs(d - near[rank - 1][0]) < 1e-9


def _plain_nearest(k, q, t):
    out = []
    for i in range(len(q[0])):
        legal = [j for j in range(len(t[0])) if q[1][i] != t[1][j] and q[2][i] != t[2][j] and (q[3][i] == 0 or q[3][i] != t[3][j])]
        d = {j: np.sqrt(((q[4][i : i + 1] - t[4][j : j + 1]) ** 2).sum(1))[0] for j in legal}
        out.append([(int(t[0][j]), float(d[j])) for j in sorted(legal, key=lambda j: (d[j], t[1][j], t[0][j]))[:k]])
    return out


@pytest.mark.parametrize("kind", ["normal", "copies", "whole", "far off", "tiny", "huge"])
def test_the_sieve_loses_no_neighbour(monkeypatch, kind):
    for name, value in {"STEP": 7, "FIRST": 5, "PIECE": 9, "MEASURED": 11}.items():
        monkeypatch.setattr(neighbours, name, value)
    draw = np.random.default_rng(5)

    def made(n, first):
        i = np.arange(first, first + n)
        draw.shuffle(i)
        x = draw.normal(size=(n, 5))
        x = {"copies": x[draw.integers(0, 3, n)], "whole": np.round(x), "far off": x + 1e9, "tiny": x * 1e-30, "huge": x * 1e100}.get(kind, x)
        return i, i // 2, (i // 10) % 3, (i // 10) % 3, x

    q, t = made(30, 0), neighbours._ordered(made(90, 15))
    for k in (1, 6, 70):
        got = [[] for _ in range(30)]
        for r, c, d in zip(*neighbours._nearest(k, q, t), strict=True):
            got[r].append((int(t[0][c]), float(d)))
        assert got == _plain_nearest(k, q, t)


def test_a_block_of_copies_sends_no_more_than_k_rows_a_query():
    n, k = 300, 4
    kinds = {"row_id": pa.int64(), "case_id": pa.int64(), "lineage": pa.int64(), "seed": pa.int64(), "x": pa.list_(pa.float64())}
    rows = [{"row_id": n - i, "case_id": n - i, "lineage": i % 2, "seed": 0, "x": [1.0, 2.0]} for i in range(n)]
    one = pa.array([rows], pa.list_(pa.struct(kinds)))
    (got,) = neighbours._meet(k, True)([pa.record_batch([one, one], names=["q", "t"])])
    assert got.num_rows == n * k and set(got.column("distance").to_pylist()) == {0.0}
    # The first by case of the other lineage.
    assert sorted(set(got.column("neighbour").to_pylist())) == list(range(1, 2 * k + 1))
