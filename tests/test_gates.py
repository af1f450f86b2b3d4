"""Gates against plain loops over a dictionary of readings."""

import math
import random

import pytest

from vicinage.operators import gates

FAMILIES, FOLDS = ["f0", "f1", "f2", "f3"], [str(i) for i in range(6)]
SCHEMA = "component string, arm string, scope string, metric string, member string, value double"


def sound(rules, component, rng):
    """Readings that qualify, with some spread."""
    out = []
    points = [*rules.below, *rules.above, *rules.others, "coverage"]
    good = {"improvement": (0.3, 0.5), "coverage": (0.95, 0.97)}
    for arm in ("base", "new"):
        for scope, members in (("POINT", ["ALL"]), ("FOLD", FOLDS), ("FAMILY", FAMILIES)):
            for metric in points:
                low, high = good.get(metric, (0.1, 0.12) if arm == "new" else (0.19, 0.2))
                out += [(component, arm, scope, metric, m, rng.uniform(low, high)) for m in members]
    for metric in points[:-1]:
        out.append((component, "new", "BOUND", metric, "ALL", rng.uniform(*good.get(metric, (0.15, 0.2)))))
    out += [(component, "new", "FAMILY_BOUND", "oracle_nrmse", f, rng.uniform(0.5, 0.9)) for f in FAMILIES]
    return out + [(component, "new", "RATIO_BOUND", m, "ALL", rng.uniform(0.7, 0.85)) for m in rules.ratios]


def plain(readings, r, fresh):
    """(absolute evaluable, passed, relative evaluable, passed) of one component."""
    seen = {}
    for _, *key, v in readings:
        seen.setdefault(tuple(key), []).append(v)
    get = lambda arm, scope, metric, member="ALL": (lambda v: v[0] if len(v) == 1 and v[0] is not None else math.nan)(seen.get((arm, scope, metric, member), []))
    new = lambda *k: get("new", *k)
    base = lambda *k: get("base", *k)
    ok = math.isfinite
    fold_metrics = [*r.below, *(["coverage"] if fresh else [])]
    fold_both = [*r.ratios, *(["coverage"] if fresh else [])]
    a_need = [new("POINT", m) for m in (*r.below, *r.above, *r.others, "coverage")] + [new("BOUND", m) for m in (*r.below, *r.above)]
    a_need += [new("FAMILY", m, f) for m in ("oracle_nrmse", "coverage") for f in FAMILIES] + [new("FAMILY_BOUND", "oracle_nrmse", f) for f in FAMILIES]
    a_need += [new("FOLD", m, f) for m in fold_metrics for f in FOLDS]
    a_ok = all(map(ok, a_need))
    under = lambda m, v, limit: v < limit if m in r.strict else v <= limit
    a = all(under(m, new("POINT", m), p) and under(m, new("BOUND", m), b) for m, (p, b) in r.below.items())
    a &= all(new("POINT", m) >= p and new("BOUND", m) >= b for m, (p, b) in r.above.items())
    family = all(new("FAMILY", "oracle_nrmse", f) <= 0.85 and new("FAMILY_BOUND", "oracle_nrmse", f) <= 1 for f in FAMILIES)
    covered = new("POINT", "coverage") >= 0.9 and all(new("FAMILY", "coverage", f) >= 0.8 for f in FAMILIES)
    a = a_ok and a and family and covered
    r_need = [g("POINT", m) for g in (new, base) for m in (r.steady, *r.ratios, "coverage")] + [new("RATIO_BOUND", m) for m in r.ratios]
    r_need += [g("FAMILY", m, f) for g in (new, base) for m in ("oracle_nrmse", "coverage") for f in FAMILIES] + [new("FAMILY_BOUND", "oracle_nrmse", f) for f in FAMILIES]
    r_need += [g("FOLD", m, f) for g in (new, base) for m in fold_both for f in FOLDS]
    r_ok = all(map(ok, r_need)) and (not fresh or all(base("POINT", m) > 0 for m in r.ratios))
    if not r_ok:
        return a_ok, a, False, False
    rel = all(base("POINT", m) > 0 and new("POINT", m) / base("POINT", m) <= p and new("RATIO_BOUND", m) <= b for m, (p, b) in r.ratios.items())
    b, n = base("POINT", r.steady), new("POINT", r.steady)
    rel &= n - b <= 0.02 and (b <= 100 * gates.FLOOR or n / b <= 1.05)
    rel &= max(new("FAMILY", "oracle_nrmse", f) for f in FAMILIES) - max(base("FAMILY", "oracle_nrmse", f) for f in FAMILIES) <= 0.05 and family
    rel &= covered and all(new(s, "coverage", m) >= base(s, "coverage", m) - 0.05 for s, ms in (("POINT", ["ALL"]), ("FAMILY", FAMILIES)) for m in ms)
    rel &= not any(all(new("FOLD", m, f) > base("FOLD", m, f) + gates.FLOOR for m in r.ratios) for f in FOLDS)
    return a_ok, a, r_ok, rel


@pytest.mark.parametrize("name", ["OLDER", "FRESH"])
def test_verdicts_equal_plain_loops(spark, name):
    rules, rng = getattr(gates, name), random.Random(name)
    tables = {"sound": sound(rules, "sound", rng)}
    # One reading at a time is spoilt: outside, at a limit, null, NaN, infinite, missing, stated twice, zero.
    for i in range(160):
        rows = sound(rules, f"c{i}", rng)
        at = rng.randrange(len(rows))
        value = rng.choice([5.0, 0.0, -1.0, None, math.nan, math.inf, 0.85, 1.0, 0.2, 0.25, 0.6, "missing", "twice"])
        if value == "missing":
            del rows[at]
        elif value == "twice":
            rows.append(rows[at])
        else:
            rows[at] = (*rows[at][:-1], value)
        if i % 8 == 0:  # A fold in which all effects are worse.
            rows = [(*x[:-1], 0.19 + 0.2) if x[1] == "new" and x[2] == "FOLD" and x[4] == "3" and x[3] in rules.ratios and i % 16 else x for x in rows]
        if i % 10 == 0:  # Only the relative side fails.
            rows = [(*x[:-1], 0.95) if x[2] == "RATIO_BOUND" else x for x in rows]
        if i % 10 == 5:  # Only the absolute side fails.
            rows = [(*x[:-1], 0.1) if x[2] == "BOUND" and x[3] == "improvement" else x for x in rows]
        tables[f"c{i}"] = rows
    df = spark.createDataFrame([x for rows in tables.values() for x in rows], SCHEMA)
    got = {r["component"]: r for r in gates.verdicts(df, rules).collect()}
    every = got.pop("ALL")
    want = {c: plain(rows, rules, name == "FRESH") for c, rows in tables.items()}
    assert {c: tuple(r[1:5]) for c, r in got.items()} == want
    assert got["sound"]["status"] == "QUALIFIED"
    assert {r["status"] for r in got.values()} == {"QUALIFIED", "ABSOLUTE_ONLY", "RELATIVE_ONLY", "NOT_QUALIFIED", "NOT_EVALUABLE"}
    assert every["status"] == "NOT_EVALUABLE"
    # The checks say why: all true exactly where a side that can be told passes.
    said = {}
    for r in gates.checks(df, rules).collect():
        said.setdefault((r["component"], r["side"]), []).append(r["passed"])
    for c, (ae, a, re_, rel) in want.items():
        assert not ae or (all(said[c, "absolute"]) == a and None not in said[c, "absolute"])
        assert not re_ or all(said[c, "relative"]) == rel


def test_empty_and_lonely_readings(spark):
    assert gates.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0 and gates.checks(spark.createDataFrame([], SCHEMA)).count() == 0
    one = gates.verdicts(spark.createDataFrame([("c", "new", "POINT", "coverage", "ALL", 0.95)], SCHEMA)).collect()
    assert {(r["component"], r["status"]) for r in one} == {("c", "NOT_EVALUABLE"), ("ALL", "NOT_EVALUABLE")}
