"""The whole bootstrap against plain loops, and the bounds against a plain version."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from vicinage.operators import bootstrap, resampling
from vicinage.plans import resamples

KEY = ("fold", "family", "lineage", "case_id")


def fixture(spark, bad=()):
    rng = np.random.default_rng(1)
    rows = []
    for fold in range(2):
        for family in "AB":
            for lin in range(5):
                for c in range(1 + (lin * 2 + fold) % 6):
                    cid = f"{fold}{family}{lin}-{c:02d}"
                    rows.append((str(fold), family, f"L{fold}{family}{lin}", cid, float("nan") if cid in bad else float(rng.normal()), float(rng.normal() + 5)))
    return rows, spark.createDataFrame(rows, "fold string, family string, lineage string, case_id string, y double, z double")


def test_replicates_equal_plain_loops(spark):
    rows, df = fixture(spark)
    got = {(r["replicate"], r["fold"], r["family"]): r for r in resampling.resample(df, 20, "t", ["y", "z"], ["y"]).collect()}
    by = defaultdict(lambda: defaultdict(list))
    for f, m, lin, case, y, z in sorted(rows):
        by[f, m][lin].append((case, y, z))
    together = resampling.TOGETHER
    for (fold, family), lineages in by.items():
        names, m = sorted(lineages), len(lineages)
        # One block and one tile: the same named streams, drawn one after the other in plain loops.
        hit = iter(resampling.stream("t", fold, family, 0, "lineage", 0).integers(0, m, together * m).tolist())
        times = [Counter(next(hit) for _ in range(m)) for _ in range(together)]
        total = sum(k * len(lineages[names[p]]) for t in times for p, k in t.items())
        unit = iter(resampling.stream("t", fold, family, 0, "case", 0, "tile/0").random(total).tolist())
        for r in range(together):
            drawn = [[lineages[names[p]][int(next(unit) * len(lineages[names[p]]))] for _ in range(times[r][p] * len(lineages[names[p]]))] for p in range(m)]
            if r >= 20:
                continue
            own = got[r, fold, family]
            flat = [c for d in drawn for c in d]
            # Mean of occurrences: a lineage drawn k times has k means of as many cases as it has, which add up to this.
            occ = [sum(c[i] for c in d) / len(lineages[names[p]]) for i in (1, 2) for p, d in enumerate(drawn)]
            assert own["drawn"] == len(flat) and own["cases"] == len({c[0] for c in flat}) and own["lineages"] == len(times[r]) and own["m"] == m
            assert own["occ_y"] == pytest.approx(sum(occ[:m]) / m) and own["occ_z"] == pytest.approx(sum(occ[m:]) / m)
            assert own["cnt_y"] == pytest.approx(sum(c[1] for c in flat) / len(flat))
            assert own["ess"] == pytest.approx(m * m / sum(k * k for k in times[r].values()))


@pytest.mark.parametrize("block, tile", [(2048, 4096), (2, 4096), (2048, 2), (1, 1), (2, 3)])
def test_blocks_and_parts_keep_every_count(spark, monkeypatch, block, tile):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "TILE", tile)
    rows, df = fixture(spark, bad=("0A2-01", "1B3-00"))
    size, lineages = Counter(r[2] for r in rows), defaultdict(set)
    for r in rows:
        lineages[r[:2]].add(r[2])
    value = {r[:4]: r[4] for r in rows}
    n = 300
    drawn = resampling.case_weights(df, n, "t").collect()
    weight, times = defaultdict(dict), defaultdict(dict)
    for r in drawn:
        weight[r["candidate"], r["fold"], r["family"]][tuple(r[k] for k in KEY)] = r["weight"]
        times[r["candidate"], r["fold"], r["family"]][r["lineage"]] = r["lineage_times"]
    assert len(weight) == n * 4
    for key, w in weight.items():
        assert sum(times[key].values()) == len(lineages[key[1:]])
        for lin, k in times[key].items():
            assert sum(x for c, x in w.items() if c[2] == lin) == k * size[lin]
    # Draws are even over the cases: the mean of each weight is 1.
    mean = Counter()
    for w in weight.values():
        mean.update(w)
    assert all(abs(mean[c] / n - 1) < 0.6 for c in value) and abs(np.mean([mean[c] / n for c in value]) - 1) < 0.02
    got = {(r["replicate"], r["fold"], r["family"]): r for r in resampling.resample(df, n, "t", ["y"], ["y"]).collect()}
    for key, w in weight.items():
        m = len(lineages[key[1:]])
        occ, cnt = sum(x * value[c] / size[c[2]] for c, x in w.items()) / m, sum(x * value[c] for c, x in w.items()) / sum(w.values())
        own = got[key]
        assert (own["drawn"], own["cases"], own["lineages"]) == (sum(w.values()), len(w), len(times[key]))
        for a, b in ((own["occ_y"], occ), (own["cnt_y"], cnt)):
            assert (a is None) == math.isnan(b) and (a is None or a == pytest.approx(b))


def test_weights_that_repeat_are_drawn_again(spark):
    df = spark.createDataFrame([("0", "A", "p", "1", 1.0), ("0", "A", "q", "2", 2.0), (None, "A", "q", "3", 9.0)], "fold string, family string, lineage string, case_id string, y double")
    got = resampling.resample(df, 3, "t", ["y"]).collect()
    assert sorted((r["replicate"], r["occ_y"]) for r in got)[0][0] == 0 and {r["occ_y"] for r in got} == {1.0, 1.5, 2.0}
    with pytest.raises(ValueError, match="only 3 different"):
        resampling.resample(df, 4, "t", ["y"])
    assert resampling.resample(df.limit(0), 5, "t", ["y"]).count() == 0


def plain_bounds(stats, n, allowed, level=0.95):
    """Bounds of (bounds, component, direction, scale): (theta, [stat of each replicate])."""
    out = {}
    for family in {k[0] for k in stats}:
        own = {k: v for k, v in stats.items() if k[0] == family}
        value = lambda k, x: None if x is None or not math.isfinite(x) or k[3] == "log" and x <= 0 else math.log(x) if k[3] == "log" else x
        status, eligible = {}, []
        for k, (theta, draws) in own.items():
            sound, good = [x for x in draws if x is not None and math.isfinite(x)], [x for x in draws if value(k, x) is not None]
            status[k] = "NOT_EVALUABLE"
            if k[3] == "log" and theta == 0 and len(sound) >= 2 and n - len(sound) <= allowed and all(x == 0 for x in sound):
                status[k] = "EXACT_ZERO_DOMINANCE"
            elif k[3] != "log" or theta is not None and theta > 0 and len(good) >= 2 and n - len(good) <= allowed:
                eligible.append(k)
        valid = [i for i in range(n) if eligible and all(value(k, own[k][1][i]) is not None and value(k, own[k][0]) is not None for k in eligible)]
        ok = len(valid) >= 2 and n - len(valid) <= allowed
        se, worst = {}, [-math.inf] * len(valid)
        for k in eligible if ok else ():
            x, at = np.array([value(k, own[k][1][i]) for i in valid]), value(k, own[k][0])
            se[k] = 0.0 if x.min() == x.max() else float(np.std(x, ddof=1))
            ok = ok and (se[k] > 0 or x[0] == at)
            t = (at - x if k[2] == "upper" else x - at) / se[k] if se[k] > 0 else np.zeros(len(x))
            worst = np.maximum(worst, t)
        critical = max(0.0, sorted(worst)[max(0, math.ceil(level * len(valid)) - 1)]) if ok else None
        for k in own:
            if k in eligible and ok:
                end = value(k, own[k][0]) + (1 if k[2] == "upper" else -1) * critical * se[k]
                out[k] = ("EVALUABLE", len(valid), math.exp(end) if k[3] == "log" else end)
            else:
                out[k] = (status[k], len(valid) if k in eligible else n if status[k] == "EXACT_ZERO_DOMINANCE" else 0, 0.0 if status[k] == "EXACT_ZERO_DOMINANCE" else None)
    return out


def test_bounds_equal_a_plain_version(spark):
    rng, n = np.random.default_rng(7), 100
    draw = lambda m, s: rng.normal(m, s, n).tolist()
    put = lambda x, at, v: [v if i in at else y for i, y in enumerate(x)]
    stats = {
        ("a", "x", "upper", "identity"): (1.0, draw(1, 0.2)), ("a", "y", "upper", "identity"): (3.0, put(draw(3, 0.4), {5}, None)),
        ("low", "x", "lower", "identity"): (1.0, draw(1, 0.2)), ("low", "y", "lower", "identity"): (2.0, [2.0] * n),
        ("log", "x", "upper", "log"): (1.2, np.exp(draw(0.1, 0.3)).tolist()), ("log", "y", "upper", "log"): (0.9, put(np.exp(draw(0, 0.2)).tolist(), {7}, 0.0)), ("log", "z", "upper", "log"): (0.0, [0.0] * n),
        ("many", "x", "upper", "identity"): (1.0, put(draw(1, 0.2), {1, 2, 3}, float("nan"))), ("many", "y", "upper", "identity"): (1.0, draw(1, 0.2)),
        ("stuck", "x", "upper", "identity"): (1.0, [2.0] * n), ("stuck", "y", "upper", "identity"): (1.0, draw(1, 0.2)),
        ("base", "x", "upper", "log"): (0.0, draw(1, 0.01)), ("base", "y", "upper", "log"): (1.0, np.exp(draw(0, 0.1)).tolist()),
        ("none", "x", "upper", "identity"): (float("nan"), draw(1, 0.1)), ("few", "x", "upper", "log"): (1.0, put(np.exp(draw(0, 0.1)).tolist(), {1, 2, 3}, -1.0)),
    }
    rows = [(*k, r, x) for k, (theta, draws) in stats.items() for r, x in [(-1, theta), *enumerate(draws)]]
    df = spark.createDataFrame(rows, "bounds string, component string, direction string, scale string, replicate long, stat double")
    got = {tuple(r[k] for k in ("bounds", "component", "direction", "scale")): r for r in bootstrap.simultaneous_bounds(df, n).collect()}
    want = plain_bounds(stats, n, 2)
    assert set(got) == set(want)
    for k, (status, valid, bound) in want.items():
        assert (got[k]["status"], got[k]["valid"], got[k]["degenerate"]) == (status, valid, n - valid), k
        assert got[k]["bound"] == (bound if bound is None else pytest.approx(bound)), k
    assert {v[0] for v in want.values()} == {"EVALUABLE", "NOT_EVALUABLE", "EXACT_ZERO_DOMINANCE"}
    assert bootstrap.simultaneous_bounds(df.limit(0), n).count() == 0


def test_bounds_of_all_families_equal_loops_over_replicates(spark, sf_dir):
    n = 60
    cases = resamples.arm_cases(spark, sf_dir)
    values = [f"{k}_{c}" for k in ("ss", "ms", "den") for c in "ynb"]
    strata = resamples.with_points(cases, resampling.resample(cases, n, resamples.DOMAIN, values, values), values).toPandas()
    names = sorted(strata.family.unique())
    whole, own = strata.groupby("replicate").mean(numeric_only=True), strata.groupby(["replicate", "family"]).mean(numeric_only=True)
    stats = {}
    for c in "ynb":
        ratio = {a: whole[f"occ_{a}_{c}"] / whole[f"occ_den_{c}"] for a in ("ss", "ms")}
        error = {a: np.sqrt(whole[f"cnt_{a}_{c}"] / whole[f"cnt_den_{c}"]) for a in ("ss", "ms")}
        one = {"paired_balanced_ratio": ratio["ms"] / ratio["ss"], "paired_conditional_variance": whole[f"cnt_ms_{c}"] / whole[f"cnt_ss_{c}"], "paired_nrmse": error["ms"] / error["ss"]}
        for a in ("ss", "ms"):
            one |= {f"{a}_balanced_ratio": ratio[a], f"{a}_conditional_variance": whole[f"cnt_{a}_{c}"], f"{a}_nrmse": error[a], f"{a}_improvement": 1 - error[a]}
            one |= {f"{a}_nrmse_{f}": np.sqrt(own.xs(f, level="family")[f"cnt_{a}_{c}"] / whole[f"cnt_den_{c}"]) for f in names}
        for k, v in one.items():
            key = (k, c, "lower" if k.endswith("improvement") else "upper", "log" if k.startswith("paired") else "identity")
            stats[key] = (v[-1], [v[r] for r in range(n)])
    want = plain_bounds(stats, n, n // 50)
    got = {tuple(r[k] for k in ("bounds", "component", "direction", "scale")): r for r in resamples.all_bounds(spark, sf_dir, n).collect()}
    assert set(got) == set(want) and len(got) == 3 * (11 + 2 * len(names))
    for k, (status, _, bound) in want.items():
        assert got[k]["status"] == status and got[k]["bound"] == pytest.approx(bound, rel=1e-9), k


def test_drawn_sums_equal_the_draws_in_chunks(spark, monkeypatch):
    from vicinage.operators import bootstrap

    monkeypatch.setattr(bootstrap, "CHUNK", 3)
    monkeypatch.setattr(bootstrap, "TOGETHER", 4)
    rows = [(f, g, 10 * f + i, [1.5, None, float("inf"), 2.0][i % 4] if f else float(i)) for f in (0, 1) for g in "ab" for i in range(8)]
    table = spark.createDataFrame(rows, "fold long, family string, lineage long, v double")
    got = {(r["replicate"], r["fold"], r["family"]): r for r in bootstrap.drawn_sums(table, 9, "d", ["v"]).collect()}
    want: dict = {}
    for r in bootstrap.draws(table, 9, "d").collect():
        want.setdefault((r["replicate"], r["fold"], r["family"]), []).append(r["lineage"])
    value = {(f, g, x): v for f, g, x, v in rows}
    assert set(got) == set(want)
    for k, drawn in want.items():
        r, vs = got[k], [value[*k[1:], x] for x in drawn]
        sound = [v for v in vs if v is not None and v < float("inf")]
        assert (r["m"], r["drawn"], r["total"], r["own"], sorted(r["shared"])) == (8, 8, sum(drawn), 0, sorted(set(drawn)))
        assert r["squares"] == sum(drawn.count(x) ** 2 for x in set(drawn)) and r["bad"] == [len(vs) - len(sound)] and abs(r["sums"][0] - sum(sound)) < 1e-9


def test_a_task_sends_sums_of_all_its_tiles(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 2)
    monkeypatch.setattr(resampling, "TILE", 2)
    _, df = fixture(spark, bad=("0A2-01",))
    laid = resampling.tiles(df, ["y", "z"])
    # What a tile carries does not hold the ids that only its order asks for.
    assert [f.name for f in laid.schema["cases"].dataType.elementType] == ["place", "h0", "h1", "n", "v"]
    at, names = np.array([0, 1]), [str(i) for i in range(10 + 6)]
    table = laid.orderBy(*resampling._KEY, "block", "tile").toArrow()
    table = table.append_column("share", [[0] * len(table)]).combine_chunks()
    asked = []
    monkeypatch.setattr(resampling, "stream", lambda *name, f=resampling.stream: (asked.append(name), f(*name))[1])
    one = list(resampling._sums("t", range(2), 1, at, at, names)(iter(table.to_batches())))
    # Four strata and two groups of replicates, however many tiles; lineages of a block are drawn once.
    assert len(table) > 30 and len(one) == 8
    drawn = [n for n in asked if n[4] == "lineage"]
    assert len(drawn) == len(set(drawn)) < 2 * len(table)
    monkeypatch.setattr(resampling, "EXACT", 0)
    for a, b in zip(one, resampling._sums("t", range(2), 1, at, at, names)(iter(table.to_batches())), strict=True):
        assert a.equals(b)


def test_numerals_are_made_once_and_weights_summed_together(monkeypatch):
    import hashlib

    import pyarrow as pa

    for k, v in {"HASHED": 4, "WEIGHED": 20, "TOGETHER": 6}.items():
        monkeypatch.setattr(bootstrap, k, v)
    bootstrap._numerals.cache_clear()
    m, held = 11, [{"place": i, "lineage": 100 + i, "shared": i % 3 == 0, "v": [float(i), float("nan") if i == 7 else 1.0]} for i in range(5, 11)]
    kind = pa.list_(pa.struct({"place": pa.int64(), "lineage": pa.int64(), "shared": pa.bool_(), "v": pa.list_(pa.float64())}))
    one = {"fold": [1], "family": ["a"], "m": [m], "start": [5], "fold_text": ["1"], "family_text": ["a"], "block": [1]}
    batch = pa.record_batch({**{k: pa.array(v) for k, v in one.items()}, "lineages": pa.array([held], kind)})
    listed = {"shared": pa.list_(pa.int64()), "sums": pa.list_(pa.float64()), "bad": pa.list_(pa.float64())}
    names = ["replicate", "fold", "family", "m", "drawn", "squares", "total", "own", "shared", "sums", "bad"]
    schema = pa.schema([(k, listed.get(k, pa.string() if k == "family" else pa.int64())) for k in names])
    got = [r for b in bootstrap._drawn_sums(11, "d", schema)([batch]) for r in b.to_pylist()]
    assert [r["replicate"] for r in got] == [6, 7, 8, 9, 10]
    for r in got:
        hits = [int(hashlib.sha256(f"d|{r['replicate']}|1|a|{i}".encode()).hexdigest()[:12], 16) % m for i in range(m)]
        w = {i: hits.count(i) for i in range(5, 11)}
        assert (r["drawn"], r["squares"], r["total"]) == (sum(w.values()), sum(x * x for x in w.values()), sum(x * (100 + i) for i, x in w.items()))
        assert r["own"] == sum(1 for i, x in w.items() if x and i % 3) and sorted(r["shared"]) == [100 + i for i, x in w.items() if x and not i % 3]
        assert r["sums"] == [sum(x * i for i, x in w.items()), sum(x for i, x in w.items() if i != 7)] and r["bad"] == [0, w[7]]
    # Three pieces of four numerals, whatever the number of replicates.
    assert bootstrap._numerals.cache_info().misses == 3
    bootstrap._numerals.cache_clear()
