"""Draw tables, nested JSON and frozen weights against plain loops."""

import json
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from vicinage.operators import drawtables, models, nested_json, replay

CASES = [(f, fam, f"{f}{fam}{i}", f"{f}{fam}{i}-{c}") for f in (0, 1) for fam in "AB" for i in range(3 + f) for c in range(1 + (i + f) % 3)]
DRAWS = "replicate long, fold long, family string, occurrence long, lineage string, place long, case_id string"


def _table(rng, replicates):
    by = {}
    for f, fam, lin, case in CASES:
        by.setdefault((f, fam), {}).setdefault(lin, []).append(case)
    out = []
    for r in range(replicates):
        for (f, fam), lins in by.items():
            for o in range(len(lins)):
                lin = rng.choice(sorted(lins))
                out += [(r, f, fam, o, lin, p, rng.choice(lins[lin])) for p in range(len(lins[lin]))]
    return out


def test_every_kind_of_draw_fault_is_found(spark):
    cases = spark.createDataFrame(CASES, "fold long, family string, lineage string, case_id string")
    good = _table(random.Random(5), 12)

    def faults(rows, n=12):
        return drawtables.draw_faults(spark.createDataFrame(rows, DRAWS), cases, n).first().asDict()

    clean = faults(good)
    assert clean.pop("rows") == len(good) and set(clean.values()) == {0}
    two = next(x for x in good if sum(y[:4] == x[:4] for y in good) == 2)
    at = good.index(two)
    other = next(c for c in CASES if c[:2] != two[1:3])
    swap = lambda new: [*good[:at], new, *good[at + 1 :]]
    assert faults(swap((*two[:6], "nowhere")))["unknown"] == 1
    assert faults(swap((*two[:6], None)))["unknown"] == 1
    assert faults(swap((*two[:6], other[3])))["moved"] == 1
    assert faults(swap((*two[:4], "another", *two[5:])))["mixed"] == 1
    short = faults(good[:at] + good[at + 1 :])
    assert short["wrong_size"] == 1
    assert faults(swap((*two[:5], 7, two[6])))["wrong_places"] == 1
    assert faults(swap((*two[:5], None, two[6])))["wrong_places"] == 1
    assert faults([x for x in good if x[:4] != two[:4]])["wrong_strata"] == 1
    assert faults([x for x in good if x[:3] != two[:3]])["wrong_strata"] == 1
    assert faults([x for x in good if x[0] != 4])["missing"] == 1
    again = [x for x in good if x[0] != 4] + [(4, *x[1:]) for x in good if x[0] == 9]
    got = faults(again)
    assert got["repeated"] == 1 and got["missing"] == 0
    none = faults([])
    assert none["missing"] == 12 and none["rows"] == 0


def test_occurrences_are_judged_as_their_rows_are(spark):
    cases = spark.createDataFrame(CASES, "fold long, family string, lineage string, case_id string")
    rng = random.Random(8)
    row = "replicate long, fold long, family string, occurrence long, entries array<struct<lineage: string, place: long, case_id: string>>"

    def both(rows):
        by = {}
        for x in rows:
            by.setdefault(x[:4], []).append(x[4:])
        one = spark.createDataFrame([(*k, rng.sample(v, len(v))) for k, v in by.items()], row)
        flat = drawtables.draw_faults(drawtables.entries(one), cases, 12).first().asDict()
        assert drawtables.occurrence_faults(one, cases, 12).first().asDict() == flat
        return flat

    good = _table(rng, 12)
    seen = dict.fromkeys(drawtables.KINDS, 0)
    for i in range(8):
        bad = [x for x in good if x[0] not in (3, 4) and rng.random() > 0.01] + [(3, *x[1:]) for x in good if x[0] == 5] if i else good
        for _ in range(4 * i):
            at, c = rng.randrange(len(bad)), rng.choice(CASES)
            r, f, fam, o, lin, p, case = bad[at]
            bad[at] = rng.choice([(r, f, fam, o, c[2], p, case), (r, f, fam, o, None, p, case), (r, f, fam, o, lin, rng.choice([None, -1, 0, 9]), case), (r, f, fam, o, lin, p, rng.choice([None, "nowhere", c[3]])), (r, c[0], c[1], o, lin, p, case), (r, f, fam, 7, lin, p, case)])
        got = both(bad)
        assert i or set(got.values()) == {len(good), 0}
        seen = {k: seen[k] + got[k] for k in seen}
    assert min(seen.values()) > 0 and both(good[:1])["missing"] == 11
    none = drawtables.occurrence_faults(spark.createDataFrame([(0, 0, "A", 0, [])], row), cases, 12).first().asDict()
    assert none["missing"] == 12 and none["rows"] == 0


def test_a_draw_table_shuffles_rows_a_lineage_not_a_replicate_and_case(spark):
    cases = spark.createDataFrame([(f, "A", 10 * f + i, 1000 * f + 50 * i + c) for f in (0, 1) for i in range(10) for c in range(20)], "fold long, family string, lineage long, case_id long")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = set(shuffled())
    got = drawtables.occurrence_faults(drawtables.case_draws(cases, 50, "s", "d"), cases, 50).first().asDict()
    # 20,000 entries, 1,000 occurrences, 400 cases.
    assert got.pop("rows") == 20_000 and set(got.values()) == {0}
    assert sum(n for k, n in shuffled().items() if k not in before) < 6_000


def _plain(value, names, depth=1):
    if isinstance(value, dict):
        for k in sorted(value):
            if k.lower() in names:
                return (depth, value[k])
        members = [value[k] for k in sorted(value)]
    else:
        members = value if isinstance(value, list) else []
    for m in members:
        found = _plain(m, names, depth + 1)
        if found is not None and found[1] is not None:
            return found
    return None


def _document(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.2:
        return rng.choice([1, "x", None, True, 2.5, '{"k": 9}'])
    if kind < 0.45:
        return [_document(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: _document(rng, depth - 1) for k in rng.sample(["a", "b", "c", "d", "K", "k", "q"] if rng.random() < 0.5 else ["a", "b", "c", "d"], rng.randrange(1, 4))}


def test_deep_first_equals_plain_recursion(spark):
    rng = random.Random(11)
    docs = [(i, json.dumps(_document(rng, rng.randrange(1, 7)))) for i in range(400)]
    for depth in range(1, 6):  # At every depth, absent and null.
        for j, tail in enumerate(['{"k": 7}', '{"z": 7}', '{"k": null, "m": {"k": 3}}']):
            text = tail
            for i in range(depth - 1):
                text = '{"w": %s}' % text if i % 2 else "[0, %s]" % text
            docs.append((1000 + 10 * depth + j, text))
    docs += [(2000, None), (2001, "no json"), (2002, ""), (2003, "{}")]
    df = spark.createDataFrame(docs, "id long, doc string")
    got = {r["id"]: (r["depth"], r["value"]) for r in nested_json.deep_first(df, "id", "doc", ["K"]).collect()}
    assert len(got) == len(docs)
    hits = 0
    for i, text in docs:
        try:
            want = _plain(json.loads(text), {"k"}) if text else None
        except ValueError:
            want = None
        if want is None or want[1] is None:
            assert got[i] == (None, None), text
        else:
            hits += 1
            assert (got[i][0], json.loads(got[i][1])) == want, text
    assert hits > 100 and nested_json.deep_first(df.limit(0), "id", "doc", ["k"]).count() == 0


def test_nested_first_takes_the_first_present_path(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "c": 2}',), ('{"a": {}, "c": 2}',), ('{"a": {"b": null}, "c": 2}',), ('{"a": 3}',), (None,), ("no",)], "doc string")
    assert [r[0] for r in df.select(nested_json.nested_first("doc", "$.a.b", "$.c")).collect()] == ["1", "2", "null", None, None, None]


def test_replay_equals_the_fit_and_refuses_changes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(size=120) / 10
    rows = spark.createDataFrame([(i % 4, [float(v) for v in x[i]], float(y[i])) for i in range(120)] + [(0, [1.0, 2.0, float("nan"), 0.0], 1.0)], "fold long, x array<double>, y double")
    by = models.moments(rows.selectExpr("fold", "concat(array(1.0D), x, array(y)) AS z"), "fold", "z")
    names = list("abcd")
    frozen = replay.freeze(spark, by, names)
    again = replay.replay(rows, frozen, "x", names, "y")
    got = {r["fold"]: r for r in again.collect()}
    for f in range(4):
        train, test = np.arange(120) % 4 != f, np.arange(120) % 4 == f
        c = x[train] - x[train].mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(4), c.T @ (y[train] - y[train].mean()))
        p = (x[test] - x[train].mean(0)) @ w + y[train].mean()
        assert got[f]["rows"] == 30 and abs(got[f]["nrmse"] - np.sqrt(((p - y[test]) ** 2).mean() / (y[test] ** 2).mean())) < 1e-9
    with pytest.raises(PySparkException, match="other columns"):
        replay.replay(rows, frozen, "x", ["b", "a", "c", "d"], "y").collect()
    changed = frozen.selectExpr("fold", "columns", "transform(weights, w -> w + 1e-12) AS weights", "fingerprint")
    with pytest.raises(PySparkException, match="changed since"):
        replay.replay(rows, changed, "x", names, "y").collect()
    published = again.selectExpr("fold", "CASE fold WHEN 1 THEN nrmse + 1e-6 WHEN 2 THEN nrmse + 1e-9 ELSE nrmse END AS nrmse").filter("fold < 3")
    status = {r["fold"]: r["status"] for r in replay.replayed(published, again.filter("fold > 0")).collect()}
    assert status == {0: "MISSING", 1: "CHANGED", 2: "OK", 3: "UNKNOWN"}
    assert replay.replay(rows.limit(0), frozen, "x", names, "y").count() == 0
