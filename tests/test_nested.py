"""Nested selection against plain loops, a planted leak, and neighbours by lineage."""

import math

import numpy as np
import pytest

from vicinage.operators import neighbours, nested

SCHEMA = "row_id long, case_id long, lineage long, family string, fold long, seed long, x array<double>, y double"


def plain(rows, positions, alpha=1.0):
    """fold -> (best, inner losses, outer losses, base) by loops over rows; rows as in SCHEMA."""
    folds, fams = sorted({r[4] for r in rows}), sorted({r[3] for r in rows})

    def mean_by(values):
        """Mean over families of mean over cases, and the families' means."""
        out = []
        for m in fams:
            case = {}
            for r, v in values:
                if r[3] == m:
                    case.setdefault(r[1], []).append(v)
            if case:
                out.append(np.mean([np.mean(v) for v in case.values()]))
        return float(np.mean(out)), out

    def ridge(train, test, terms):
        x, y = np.array([terms(r) for r in train]), np.array([r[7] for r in train])
        c = x - x.mean(0)
        beta = np.linalg.solve(c.T @ c + alpha * np.eye(c.shape[1]), c.T @ (y - y.mean()))
        return [float(y.mean() + (np.array(terms(r)) - x.mean(0)) @ beta) for r in test]

    def quad(r):
        v = [r[6][i] for i in positions]
        return v + [v[i] * v[j] for i in range(len(v)) for j in range(i, len(v))]

    def tested(train, test):
        rms = math.sqrt(mean_by([(r, r[7] ** 2) for r in train])[0])
        pred = {"ridge": ridge(train, test, lambda r: r[6]), "polynomial_ridge": ridge(train, test, quad), "mean": [mean_by([(r, r[7]) for r in train])[0]] * len(test)}
        for k in nested.NEAR:
            pred[f"knn{k}"] = []
            for q in test:
                near = sorted((math.dist(q[6], t[6]), t[1], t[0], t[7]) for t in train if t[1] != q[1] and t[4] != q[4] and (q[5] == 0 or q[5] != t[5]))
                pred[f"knn{k}"].append(np.mean([n[3] for n in near[:k]]) if len(near) >= k else math.nan)
        return {name: float(np.mean([math.sqrt(e) / rms for e in mean_by([(q, (v - q[7]) ** 2) for q, v in zip(test, p, strict=True)])[1]])) for name, p in pred.items()}

    out = {}
    for f in folds:
        inner = [tested([r for r in rows if r[4] not in (f, v)], [r for r in rows if r[4] == v]) for v in folds if v != f]
        score = {name: float(np.mean([one[name] for one in inner])) for name in nested.ORDER}
        good = [name for name in nested.ORDER if math.isfinite(score[name])]
        out[f] = (min(good, key=lambda name: (score[name], nested.ORDER.index(name))) if good else None, score, tested([r for r in rows if r[4] != f], [r for r in rows if r[4] == f]))
    return out


def fixture(twins):
    rng, rows = np.random.default_rng(11), []
    for i in range(240):
        fold = i % 6
        x = rng.normal(size=6)
        y = float(x[0] * 0.4 + x[1] * x[2] * 0.3 + rng.normal())
        if twins and fold == 1 or twins and fold == 2:
            # As good as a copy of a row of fold 0: only a neighbour that lies there tells its target.
            x, y = np.array(rows[i - fold][6]) + 1e-6, rows[i - fold][7]
        rows.append((i, i // 12 * 6 + fold, i, "AB"[i // 6 % 2], fold, i % 3, x.tolist(), y))
    return rows


@pytest.mark.parametrize("twins", [False, True])
def test_selection_equals_plain_loops(spark, twins):
    rows = fixture(twins)
    odd = [(900, 1, 1, "A", 0, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1.0), (901, 1, 1, "A", 0, 0, None, 1.0), (902, 1, 1, "A", 0, 0, [0.0] * 6, float("nan")), (903, 1, 1, "A", None, 0, [0.0] * 6, 1.0)]
    got = {r["fold"]: r for r in nested.nested_selection(spark.createDataFrame(rows + odd, SCHEMA), [0, 1, 2]).collect()}
    want = plain(rows, [0, 1, 2])
    assert set(got) == set(want)
    for f, (best, inner, outer) in want.items():
        assert got[f]["best"] == best and got[f]["status"] == "SELECTED"
        for name in nested.ORDER:
            assert got[f][f"inner_{name}"] == pytest.approx(inner[name], rel=1e-9)
            assert got[f][f"outer_{name}"] == pytest.approx(outer[name], rel=1e-9)
        assert got[f]["improvement"] == pytest.approx(1 - outer[best] / outer["mean"])


def test_a_leak_would_change_the_winner(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(100):
        x, y, fold = rng.normal(size=4), float(rng.normal()), 1 + i % 5
        rows.append((i, i, i, "AB"[i // 5 % 2], fold, 0, x.tolist(), y))
        # Fold 0 holds five rows beside each of the others, with its target.
        rows += [(1000 + 5 * i + j, 1000 + 5 * i + j, 1000 + i, "AB"[i // 5 % 2], 0, 0, (x + 1e-6 * (j + 1)).tolist(), y) for j in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = {r["fold"]: r for r in nested.nested_selection(df, [0, 1]).collect()}[0]
    every = {(r["fold"], r["without"]): r for r in nested.losses(df, [0, 1]).collect()}
    # Trained with the outer fold 0, neighbours know all targets of the inner folds.
    leaky = {name: np.mean([every[v, v][name] for v in range(1, 6)]) for name in nested.ORDER}
    assert min(leaky, key=leaky.get) == "knn5" and leaky["knn5"] < 1e-6
    assert chosen["best"] != "knn5" and chosen["inner_knn5"] > 0.5


def test_too_few_neighbours_leave_a_predictor_out_and_empty_tables(spark):
    rows = [r for r in fixture(False) if r[0] < 36]
    got = nested.nested_selection(spark.createDataFrame(rows, SCHEMA), [0]).collect()
    assert all(r["inner_knn20"] is None and r["best"] != "knn20" for r in got) and len(got) == 6
    assert nested.nested_selection(spark.createDataFrame([], SCHEMA), [0]).count() == 0


@pytest.mark.parametrize("block, few", [(2048, 8), (16, 2)])
def test_neighbours_by_lineage(spark, monkeypatch, block, few):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "FEW", few)
    rng = np.random.default_rng(3)
    at = rng.normal(size=(12, 3)) * 40
    rows = [(i, i // 2, i % 5, i % 3, (at[i % 12] + rng.normal(size=3)).round(1).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, case_id long, lineage long, seed long, x array<double>")
    got = {}
    for r in neighbours.legal_neighbours(df, df, 3, by_lineage=True).collect():
        got.setdefault((r["query"], r["lineage"]), []).append((r["rank"], r["neighbour"]))
    for q in rows:
        for lin in range(5):
            near = sorted((math.dist(q[4], t[4]), t[1], t[0]) for t in rows if t[2] == lin and lin != q[2] and t[1] != q[1] and (q[3] == 0 or q[3] != t[3]))[:3]
            assert sorted(got.get((q[0], lin), [])) == [(i + 1, n[2]) for i, n in enumerate(near)]


def test_neighbours_are_put_in_order_once_for_all_sets_of_folds(spark):
    draw = np.random.default_rng(8)
    rows = [(i, i // 2, i // 4, "a", i % 3, 0, [float(v) for v in draw.integers(0, 3, 2)], float(i)) for i in range(60)]
    got = nested.neighbour_means(spark.createDataFrame(rows, SCHEMA), [0, 1, 2])
    # That of the neighbours themselves; sets of folds are taken from a query's own list.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" :+-").startswith("Window ") for line in plan.splitlines()) == 1
    found = {(r["row_id"], r["without"]): r for r in got.collect()}
    assert len(found) == 180
    for i, case, _, _, fold, _, x, _ in rows:
        for without in range(3):
            near = sorted((math.dist(x, t[6]), t[1], t[0], t[7]) for t in rows if t[4] not in (fold, without) and t[1] != case)
            for k in nested.NEAR:
                want = sum(t[3] for t in near[:k]) / k if len(near) >= k else None
                assert found[i, without][f"knn{k}"] == pytest.approx(want)
