"""Gates and verdicts on the neighbours of two arms, from their readings on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite, strict_mean
from ..operators import gates
from ..operators.quantiles import quantiles
from ..sources.scratch import written
from .base import K, knn_sql, neighbours, points, points_sql, query

_DIMS = {"base": 8, "new": 64}
_COMPONENTS = ("label", "first", "second")
_METRICS = ("candidate_c", "dnn_median", "dnn_p90", "conditional_variance", "oracle_nrmse", "baseline_nrmse", "improvement", "coverage")


def _targets(p: DataFrame) -> DataFrame:
    """(row_id, fold, family, component, y): the label and the first two entries of a vector as targets."""
    each = F.array(*[F.struct(F.lit(c).alias("component"), v.alias("y")) for c, v in zip(_COMPONENTS, (F.col("y"), F.col("x")[0], F.col("x")[1]), strict=True)])
    return p.select("row_id", F.col("fold").cast("string").alias("fold"), F.col("family").cast("string").alias("family"), F.inline(each)).filter(finite(F.col("y")))


def _measures(spark, d: str, arm: str) -> DataFrame:
    """Per row and component: how far and how varied its neighbours' targets are, in parts of the target's spread."""
    p = points(spark, d, _DIMS[arm])
    t = written(_targets(p), "targets")
    spread = t.groupBy("component").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("s"))
    e = written(neighbours(p), "edges")
    far = e.groupBy("query").agg(F.max("distance").alias("far"))
    radius = quantiles(far, [], "far", {"radius": (0.9, "disc")})
    met = e.select(F.col("query").alias("row_id"), "neighbour").join(t, "row_id").join(t.select(F.col("row_id").alias("neighbour"), "component", F.col("y").alias("ny")), ["neighbour", "component"])
    diff = F.col("ny") - F.col("y")
    by = met.groupBy("row_id", "component", "fold", "family", "y").agg(F.avg(F.abs(diff)).alias("apart"), F.avg(diff * diff).alias("n"), F.var_pop("ny").alias("v"), F.avg(diff).alias("off"))
    # Spread of three targets, one radius.
    z = F.pow(F.col("y") - F.col("mean"), 2)
    s2 = F.col("s") * F.col("s")
    covered = far.crossJoin(F.broadcast(radius)).select(F.col("query").alias("row_id"), (F.col("far") <= F.col("radius")).cast("double").alias("covered"))
    got = by.join(F.broadcast(spread), "component").join(covered, "row_id")
    return got.select(F.lit(arm).alias("arm"), "component", "fold", "family", (F.col("apart") / F.col("s")).alias("dnn"), "n", (z + s2).alias("b"), (F.col("v") / s2).alias("v"), F.pow("off", 2).alias("e2"), z.alias("z2"), "s", "covered")


def readings(spark, d: str) -> DataFrame:
    """(component, arm, scope, metric, member, value) of both arms, with the worst fold as bound."""
    m = _measures(spark, d, "base").unionByName(_measures(spark, d, "new"))
    scopes = [("POINT", F.lit("ALL")), ("FOLD", F.col("fold")), ("FAMILY", F.col("family")), ("CELL", F.concat_ws("|", "family", "fold"))]
    m = written(m.withColumn("_at", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), c.alias("member")) for s, c in scopes]))).select("_at.*", *m.columns), "measures")
    keys = ["component", "arm", "scope", "member"]
    q = quantiles(m, keys, "dnn", {"dnn_median": (0.5, "disc"), "dnn_p90": (0.9, "disc")})
    a = m.groupBy(*keys).agg(*[strict_mean(v).alias(v) for v in ("n", "b", "v", "e2", "z2", "covered")], F.max("s").alias("s"))
    oracle, baseline = F.sqrt("e2") / F.col("s"), F.sqrt("z2") / F.col("s")
    value = {"candidate_c": F.when(F.col("b") > 0, F.col("n") / F.col("b")), "dnn_median": F.col("dnn_median"), "dnn_p90": F.col("dnn_p90"), "conditional_variance": F.col("v"), "oracle_nrmse": oracle, "baseline_nrmse": baseline, "improvement": F.when(baseline > 0, 1 - oracle / baseline), "coverage": F.col("covered")}
    long = F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), value[k].alias("value")) for k in _METRICS]))
    stated = written(a.join(q, keys).select(*keys, long), "readings")
    # Bounds: the worst fold, of all rows or of a family.
    fold = stated.filter("scope = 'FOLD' AND arm = 'new' AND metric <> 'coverage'").groupBy("component", "metric").agg(F.when(F.col("metric") == "improvement", F.min("value")).otherwise(F.max("value")).alias("value"))
    cell = stated.filter("scope = 'CELL' AND arm = 'new' AND metric = 'oracle_nrmse'").groupBy("component", "metric", F.substring_index("member", "|", 1).alias("member")).agg(F.max("value").alias("value"))
    pair = gates.paired(stated).filter(F.col("scope") == "FOLD").groupBy("component", "metric").agg(F.max(F.when(F.col("base") > 0, F.col("new") / F.col("base"))).alias("value")).filter(F.col("metric").isin(*gates.OLDER.ratios, *gates.FRESH.ratios))
    new = F.lit("new").alias("arm")
    out = stated.filter("scope <> 'CELL'").select("component", "arm", "scope", "metric", "member", "value")
    for scope, df, member in (("BOUND", fold, F.lit("ALL")), ("FAMILY_BOUND", cell, F.col("member")), ("RATIO_BOUND", pair, F.lit("ALL"))):
        out = out.unionByName(df.select("component", new, F.lit(scope).alias("scope"), "metric", member.alias("member"), "value"))
    return out


def _measures_sql(arm: str) -> str:
    src, knn = f"p_{arm}", f"k_{arm}"
    return f"""{points_sql(_DIMS[arm], src)}, {knn_sql(K, src, knn)},
t_{arm} AS (SELECT row_id, fold::VARCHAR AS fold, family::VARCHAR AS family, unnest(['label', 'first', 'second']) AS component, unnest([y, x[1], x[2]]) AS y FROM {src}),
far_{arm} AS (SELECT query, max(distance) AS far FROM {knn} GROUP BY 1),
m_{arm} AS (SELECT '{arm}' AS arm, component, fold, family, apart / s AS dnn, n, (y - mean) ** 2 + s * s AS b, v / (s * s) AS v, off ** 2 AS e2, (y - mean) ** 2 AS z2, s, (far <= (SELECT quantile_disc(far, 0.9) FROM far_{arm}))::INT::DOUBLE AS covered
  FROM (SELECT a.row_id, a.component, a.fold, a.family, a.y, avg(abs(b.y - a.y)) AS apart, avg((b.y - a.y) ** 2) AS n, var_pop(b.y) AS v, avg(b.y - a.y) AS off FROM {knn} JOIN t_{arm} a ON a.row_id = query JOIN t_{arm} b ON b.row_id = neighbour AND b.component = a.component GROUP BY ALL)
  JOIN (SELECT component, avg(y) AS mean, stddev_pop(y) AS s FROM t_{arm} GROUP BY 1) USING (component) JOIN far_{arm} ON query = row_id)"""


_READINGS = f"""{_measures_sql("base")}, {_measures_sql("new")}, m AS (SELECT * FROM m_base UNION ALL SELECT * FROM m_new),
g AS (SELECT component, arm, CASE WHEN grouping(fold) = 0 AND grouping(family) = 0 THEN 'CELL' WHEN grouping(fold) = 0 THEN 'FOLD' WHEN grouping(family) = 0 THEN 'FAMILY' ELSE 'POINT' END AS scope, fold, family,
  avg(n) / avg(b) AS candidate_c, quantile_disc(dnn, 0.5) AS dnn_median, quantile_disc(dnn, 0.9) AS dnn_p90, avg(v) AS conditional_variance, sqrt(avg(e2)) / max(s) AS oracle_nrmse, sqrt(avg(z2)) / max(s) AS baseline_nrmse, 1 - sqrt(avg(e2)) / sqrt(avg(z2)) AS improvement, avg(covered) AS coverage
  FROM m GROUP BY GROUPING SETS ((component, arm), (component, arm, fold), (component, arm, family), (component, arm, fold, family))),
u AS MATERIALIZED (UNPIVOT g ON {", ".join(_METRICS)} INTO NAME metric VALUE value),
readings AS MATERIALIZED (SELECT component, arm, scope, metric, coalesce(fold, family, 'ALL') AS member, value FROM u WHERE scope <> 'CELL'
  UNION ALL SELECT component, 'new', 'BOUND', metric, 'ALL', CASE WHEN metric = 'improvement' THEN min(value) ELSE max(value) END FROM u WHERE scope = 'FOLD' AND arm = 'new' AND metric <> 'coverage' GROUP BY component, metric
  UNION ALL SELECT component, 'new', 'FAMILY_BOUND', metric, family, max(value) FROM u WHERE scope = 'CELL' AND arm = 'new' AND metric = 'oracle_nrmse' GROUP BY component, metric, family
  UNION ALL SELECT n.component, 'new', 'RATIO_BOUND', n.metric, 'ALL', max(n.value / o.value) FROM u n JOIN u o ON o.component = n.component AND o.metric = n.metric AND o.fold = n.fold AND o.scope = 'FOLD' AND o.arm = 'base' WHERE n.scope = 'FOLD' AND n.arm = 'new' AND n.metric IN ('candidate_c', 'dnn_p90', 'conditional_variance', 'oracle_nrmse') GROUP BY n.component, n.metric)"""


def _limits_sql(r: gates.Rules) -> str:
    """Limits as rows of a table: (side, check, scope, metric, relation, limit)."""
    rows = []
    for m, limits in r.below.items():
        rows += [("absolute", f"{m}_{s.lower()}", s, m, "<" if m in r.strict else "<=", x) for s, x in zip(("POINT", "BOUND"), limits, strict=True)]
    for m, limits in r.above.items():
        rows += [("absolute", f"{m}_{s.lower()}", s, m, ">=", x) for s, x in zip(("POINT", "BOUND"), limits, strict=True)]
    rows += [("absolute", "every_family_point", "FAMILY", "oracle_nrmse", "<=", 0.85), ("absolute", "every_family_bound", "FAMILY_BOUND", "oracle_nrmse", "<=", 1.0)]
    rows += [("absolute", "coverage", "POINT", "coverage", ">=", 0.9), ("absolute", "coverage_every_family", "FAMILY", "coverage", ">=", 0.8)]
    for m, (x, y) in r.ratios.items():
        rows += [("relative", f"{m}_ratio", "RATIO", m, "<=", x), ("relative", f"{m}_ratio_bound", "RATIO_BOUND", m, "<=", y)]
    return ", ".join("('{}', '{}', '{}', '{}', '{}', {})".format(*x) for x in rows)


def _checks_sql(r: gates.Rules) -> str:
    effects = ", ".join(f"'{m}'" for m in r.ratios)
    positive = "b.value > 0 AND " if r.strict else ""
    return f"""limits(side, "check", scope, metric, relation, most) AS (VALUES {_limits_sql(r)}),
w AS (SELECT component, scope, metric, member, value FROM readings WHERE arm = 'new' UNION ALL SELECT n.component, 'RATIO', metric, 'ALL', n.value / b.value FROM readings n JOIN readings b USING (component, scope, metric) WHERE n.arm = 'new' AND b.arm = 'base' AND scope = 'POINT'),
j AS (SELECT n.component, n.scope, n.metric, n.member, b.value AS base, n.value AS new FROM readings n JOIN readings b USING (component, scope, metric, member) WHERE n.arm = 'new' AND b.arm = 'base'),
simple AS (SELECT component, side, "check", bool_and(CASE relation WHEN '<' THEN value < most WHEN '<=' THEN value <= most ELSE value >= most END) AS passed FROM w JOIN limits USING (scope, metric) GROUP BY ALL),
c AS (SELECT * FROM simple
  UNION ALL SELECT component, 'absolute', 'all_folds_valid', bool_and(isfinite(value)) FROM readings WHERE scope = 'FOLD' AND arm = 'new' GROUP BY 1
  UNION ALL SELECT component, 'relative', '{r.steady}_not_worse', {positive.replace("b.value", "base")}new - base <= 0.02 AND (base <= 100 * 128 * pow(2, -52) OR new / base <= 1.05) FROM j WHERE scope = 'POINT' AND metric = '{r.steady}'
  UNION ALL SELECT component, 'relative', 'worst_family', max(new) - max(base) <= 0.05 AND max(new) <= 0.85 AND (SELECT max(value) <= 1 FROM readings f WHERE f.scope = 'FAMILY_BOUND' AND f.component = j.component) FROM j WHERE scope = 'FAMILY' AND metric = 'oracle_nrmse' GROUP BY component
  UNION ALL SELECT component, 'relative', 'coverage_kept', bool_and(new >= base - 0.05 AND new >= CASE scope WHEN 'POINT' THEN 0.9 ELSE 0.8 END) FROM j WHERE scope IN ('POINT', 'FAMILY') AND metric = 'coverage' GROUP BY component
  UNION ALL SELECT component, 'relative', 'no_reversed_fold', max(worse) < 3 FROM (SELECT component, member, count(*) FILTER (new > base + 128 * pow(2, -52)) AS worse FROM j WHERE scope = 'FOLD' AND metric IN ({effects}) GROUP BY ALL) GROUP BY component)"""


_VERDICT = """s AS (SELECT component, bool_and(passed) FILTER (side = 'absolute') AS a, bool_and(passed) FILTER (side = 'relative') AS r FROM c GROUP BY 1),
v AS (SELECT * FROM s UNION ALL SELECT 'ALL', bool_and(a), bool_and(r) FROM s)
SELECT component, true AS absolute_evaluable, a AS absolute_passed, true AS relative_evaluable, r AS relative_passed, CASE WHEN a AND r THEN 'QUALIFIED' WHEN a THEN 'ABSOLUTE_ONLY' WHEN r THEN 'RELATIVE_ONLY' ELSE 'NOT_QUALIFIED' END AS status FROM v"""


@query("D1_D2_D3_readings", f"WITH {_READINGS} SELECT component, arm, scope, metric, member, round(value, 6) AS value FROM readings")
def d_readings(s, d):
    """Metrics of three targets by the ten nearest rows of two arms (8 and 64 entries), with bounds."""
    return readings(s, d).withColumn("value", F.round("value", 6))


def _add(name: str, rules: gates.Rules) -> None:
    @query(f"{name}_checks", f'WITH {_READINGS}, {_checks_sql(rules)} SELECT component, side, "check", passed FROM c')
    def each(s, d):
        return gates.checks(written(readings(s, d), "stated"), rules)

    @query(f"{name}_verdicts", f"WITH {_READINGS}, {_checks_sql(rules)}, {_VERDICT}")
    def tree(s, d):
        return gates.verdicts(written(readings(s, d), "stated"), rules)


_add("D1_D2_whole_gates", gates.OLDER)
_add("D3_fresh_gates", gates.FRESH)
