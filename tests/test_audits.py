import hashlib
import heapq
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from vicinage.operators import decisions, models, particles, selection
from vicinage.plans import audits, base
from vicinage.sources import publish


@pytest.mark.parametrize("loads", [[], [5], [3, 3, 3, 3, 3, 3, 3], [9, 1, 1, 1, 0, None, 4, 4, 4], list(range(40)) + [7] * 25 + [0] * 9])
def test_greedy_folds_give_the_loads_of_the_plain_loop(spark, loads):
    items = spark.createDataFrame([(i, x) for i, x in enumerate(loads)], "key long, load long")
    got = selection.greedy_folds(items, "key", "load", 3).collect()
    assert sorted(r["key"] for r in got) == list(range(len(loads)))
    heap = [(0, f) for f in range(3)]
    for x in sorted((x or 0 for x in loads), reverse=True):
        low, f = heap[0]
        heapq.heapreplace(heap, (low + x, f))
    have = Counter({f: 0 for f in range(3)})
    for r in got:
        have[r["fold"]] += r["load"] or 0
    assert sorted(have.values()) == sorted(x for x, _ in heap)


def test_balanced_select_equals_the_plain_loop(spark):
    rng = np.random.default_rng(3)
    pool = [(i, int(rng.integers(3)), int(rng.integers(4))) for i in range(60)]
    got = {r["key"]: r["step"] for r in selection.balanced_select(spark.createDataFrame(pool, "key long, a long, b long"), "key", ["a", "b"], 20).collect()}
    h = lambda k: hashlib.sha256(f"select|{k}".encode()).hexdigest()
    loads, left, want = [Counter(), Counter()], list(pool), {}
    sizes = [len({r[1] for r in pool}), len({r[2] for r in pool})]

    def score(r, step):
        now = [loads[0][r[1]], loads[1][r[2]]]
        ideal = [Fraction(step + 1, n) for n in sizes]
        deviation = sum(((n + 1 - i) ** 2 - (n - i) ** 2) / max(i, 1) for n, i in zip(now, ideal, strict=True))
        return max(Fraction((n + 1) * size, step + 1) for n, size in zip(now, sizes, strict=True)), deviation, h(r[0]), r[0]

    for step in range(20):
        best = min(left, key=lambda r: score(r, step))
        left.remove(best)
        loads[0][best[1]] += 1
        loads[1][best[2]] += 1
        want[best[0]] = step
    assert got == want


def test_ablation_equals_plain_ridge(spark, sf_dir):
    p = base.points(spark, sf_dir).select("fold", "x", "y").toPandas()
    x, y, fold = np.stack(p["x"].to_numpy()), p["y"].to_numpy(), p["fold"].to_numpy()
    for r in base.QUERIES["M7_P14_group_ablation"](spark, sf_dir).collect():
        cols = [c - 1 for c in models.designs(audits._BASE, audits._GROUPS)[r["design"]]]
        error = []
        for f in range(6):
            t = fold != f
            mx, my = x[t][:, cols].mean(0), y[t].mean()
            a = x[t][:, cols] - mx
            beta = np.linalg.solve(a.T @ a + np.eye(len(cols)), a.T @ (y[t] - my))
            error.append((y[~t] - my - (x[~t][:, cols] - mx) @ beta) ** 2)
        assert abs(np.sqrt(np.concatenate(error).mean()) - r["error"]) < 1e-5


def test_designs_drop_repeats():
    assert list(models.designs([1], {"g": [2]})) == ["base", "base+g"]
    assert models.designs([1], {}) == {"base": [1]}


# (family, lineage, [(n, b), ...] of one case); q2; values and statuses of A to D.
NE, UNB = "NO_CONTRAST", "UNBOUNDED"
FIXTURES = {
    "S1": ([("F1", 1, [(1, 1), (3, 1)]), ("F1", 2, [(1, 1), (3, 1)])], 1, (2, 2, 2, 2)),
    "S2": ([("F1", 1, [(0, 0), (1, 1)]), ("F1", 2, [(1, 1), (1, 1)])], 1, (NE, 1, 1, 0.75)),
    "S3": ([("F1", 1, [(1, 0), (1, 1)]), ("F1", 2, [(1, 1), (1, 1)])], 1, (UNB, 4 / 3, 4 / 3, 1)),
    "S4": ([("F1", 1, [(0, 0), (0, 0)]), ("F1", 2, [(1, 1), (1, 1)])], 1, (NE, 1, 1, 0.5)),
    "S6": ([("F1", 1, [(1, 0), (1, 0)]), ("F1", 2, [(1, 1), (1, 1)])], 1, (UNB, 2, 2, 1)),
    "S12": ([("F1", 1, [(9, 1)]), ("F2", 2, [(1, 1)]), ("F2", 3, [(1, 1)]), ("F2", 4, [(1, 1)])], 1, (3, 3, 5, 5)),
    "S13": ([("F1", 1, [(100, 1)]), ("F1", 2, [(1, 1)]), ("F1", 3, [(1, 1)])], 1, (34, 34, 34, 34)),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_metric_candidates(spark, name):
    cases, q2, want = FIXTURES[name]
    data = [(0, f, lineage, i, float(n), float(b)) for i, (f, lineage, ps) in enumerate(cases) for n, b in ps]
    got = {r["candidate"]: r for r in decisions.metric_candidates(spark.createDataFrame(data, "fold long, family string, lineage long, case_id long, n double, b double"), q2).collect()}
    for c, w in zip("ABCD", want, strict=True):
        assert got[c]["status"] == w if isinstance(w, str) else abs(got[c]["value"] - w) < 1e-12


def test_negative_parts_are_an_error(spark):
    bad = spark.createDataFrame([(0, "F", 1, 1, -1.0, 1.0)], "fold long, family string, lineage long, case_id long, n double, b double")
    with pytest.raises(Exception, match="negative"):
        decisions.metric_candidates(bad, 1.0).collect()


def test_pair_forces_cancel_and_uniform_motion_has_no_rate(spark):
    rng = np.random.default_rng(1)
    n = 60
    xy = rng.random((n, 2))
    p = spark.createDataFrame([(i, *map(float, xy[i]), 1.0, 2.0, 3.0, float(rng.random()), 0.01) for i in range(n)], "id long, x double, y double, density double, vx double, vy double, pressure double, mass double")
    from vicinage.operators.joins import radius_join

    e = particles.offsets(radius_join(p.select("id", "x", "y"), 0.3, 1.0), p, 1.0)
    r = particles.rates(e, p, 0.15, 0.02).toPandas()
    assert len(r) == n and np.abs(r["density_rate"]).max() < 1e-12 and np.abs(r["viscous_x"]).max() < 1e-12
    assert abs(r["pressure_x"].sum()) < 1e-9 and r["pressure_x"].abs().max() > 0


def test_radius_join_carries_both_ends(spark):
    from vicinage.operators.joins import radius_join

    rng = np.random.default_rng(2)
    xy = np.vstack([rng.random((80, 2)), [[0.0, 0.0], [0.5, 0.5], [0.999, 0.25], [0.0, 0.25]]])
    p = spark.createDataFrame([(i, float(x), float(y), float(i * i)) for i, (x, y) in enumerate(xy)], "id long, x double, y double, m double")
    for radius in (0.04, 0.3, 0.8):
        d = xy[:, None] - xy[None]
        d = d - np.sign(d) * np.floor(np.abs(d) + 0.5)
        away = np.sqrt((d**2).sum(2))
        want = {(a, b) for a, b in zip(*np.nonzero(away < radius), strict=True)}
        got = radius_join(p, radius, 1.0, ["m"]).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
        for r in got:
            assert r["a_m"] == r["a"] ** 2 and r["b_m"] == r["b"] ** 2 and np.allclose([r["dx"], r["dy"], r["distance"]], [*d[r["a"], r["b"]], away[r["a"], r["b"]]])


def test_kernel_integrates_to_one(spark):
    import pyspark.sql.functions as F

    h, step = 0.5, 0.001
    r = spark.range(1000).select((F.col("id") * step + step / 2).alias("r"))
    assert abs(r.agg(F.sum(particles.kernel(F.col("r"), h) * 2 * np.pi * F.col("r") * step)).first()[0] - 1) < 1e-4


def test_publish_is_whole_or_absent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "id long, t string, v array<double>")
    path = f"file://{tmp_path}/release"
    publish.publish(spark, {"one": df}, path)
    assert publish.exists(spark, f"{path}/MANIFEST.json")
    with pytest.raises(FileExistsError):
        publish.publish(spark, {"one": df}, path)
    # A run that stopped before its manifest is taken up again, but not over other content.
    part = f"file://{tmp_path}/part"
    df.write.parquet(f"{part}/one")
    publish.publish(spark, {"one": df, "two": df}, part)
    assert spark.read.parquet(f"{part}/two").count() == 2
    other = f"file://{tmp_path}/other"
    df.limit(1).write.parquet(f"{other}/one")
    with pytest.raises(FileExistsError):
        publish.publish(spark, {"one": df}, other)
    a, b = publish.content_hash(df).first(), publish.content_hash(df.orderBy("t").repartition(3)).first()
    assert a == b and a != publish.content_hash(df.union(df)).first() and publish.content_hash(df.limit(0)).first()["digest"] == 0


def test_checkpoint_follows_its_fingerprint(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    path = f"file://{tmp_path}/fold"
    assert [publish.checkpointed(spark, path, f, build).count() for f in ("a", "a", "b", "b")] == [1, 1, 2, 2]


def test_event_log_and_report(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    publish.append_event(spark, path, "read", train=2, test=1)
    publish.append_event(spark, path, "read", train=3)
    log = spark.read.schema("event string, at timestamp, counters map<string,bigint>").json(path)
    got = {r["counter"]: r["ok"] for r in publish.ledger_gate(log, {"train": 5, "test": 2, "never": 0}).collect()}
    assert got == {"train": True, "test": False, "never": True}
    text = publish.report("T", spark.createDataFrame([("b|c", 0.25), ("a", None)], "k string, v double"))
    assert text.splitlines()[2:] == ["| k | v |", "|-|-|", "| a |  |", "| b\\|c | 0.25 |"]
    publish.write_json(spark, f"file://{tmp_path}/x.json", {"b": float("nan"), "a": 1}, nulled=True)
    assert (tmp_path / "x.json").read_text().index('"a"') < (tmp_path / "x.json").read_text().index('"b"')
    with pytest.raises(ValueError):
        publish.write_json(spark, f"file://{tmp_path}/y.json", {"b": float("nan")})
