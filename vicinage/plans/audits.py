"""Queries on particles, decisions, selections, ablations and published content."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nulls, vectors
from ..operators import bootstrap, decisions, hierarchy, joins, models, particles, selection
from ..sources import publish
from ..sources.tables import table
from .base import K, ROWS, knn_sql, neighbours, points, points_sql, query, rows
from .neighbourhoods import _AT, DRAWS, OCC, REPLICATES, SEED

R = 6
_r = lambda c: F.round(c, R)
_z = lambda c, k=R: F.round(c, k) + F.lit(0.0)  # noqa: E731  no negative zero
_zs = lambda c, k=R: f"round({c}, {k}) + 0.0::DOUBLE"
PTS = points_sql()

# Particles: customers on a unit torus ----------------------------------------------------------------------------

SUPPORT, H, NU = 0.05, 0.025, 0.02
_STATE = """SELECT id, x, y, 1 + 0.01 * sin(2 * pi() * x) AS density, sin(2 * pi() * x) * cos(2 * pi() * y) AS vx, -cos(2 * pi() * x) * sin(2 * pi() * y) AS vy,
sin(2 * pi() * x) AS pressure, 0.001::DOUBLE AS mass FROM (SELECT c_custkey AS id, (c_custkey * 37 % 1009) / 1009.0::DOUBLE AS x, (c_custkey * 101 % 997) / 997.0::DOUBLE AS y FROM customer)"""
EDGES = f"""p AS ({_STATE}), f AS (SELECT a.id AS a, b.id AS b, a.x - b.x - round(a.x - b.x) AS dx, a.y - b.y - round(a.y - b.y) AS dy FROM p a, p b),
e AS (SELECT a, b, dx, dy, sqrt(dx * dx + dy * dy) AS dist FROM f WHERE sqrt(dx * dx + dy * dy) < {SUPPORT})"""


def _state(s, d) -> DataFrame:
    k = F.col("c_custkey")
    p = table(s, d, "customer").select(k.alias("id"), ((k * 37 % 1009) / F.lit(1009.0)).alias("x"), ((k * 101 % 997) / F.lit(997.0)).alias("y"))
    u, v = 2 * math.pi * F.col("x"), 2 * math.pi * F.col("y")
    return p.select("id", "x", "y", (1 + 0.01 * F.sin(u)).alias("density"), (F.sin(u) * F.cos(v)).alias("vx"), (-F.cos(u) * F.sin(v)).alias("vy"), F.sin(u).alias("pressure"), F.lit(0.001).alias("mass"))


def _edges(s, d, carry: tuple[str, ...] = ()) -> DataFrame:
    return joins.radius_join(_state(s, d), SUPPORT, 1.0, carry)


@query("S8_F8_particle_states", "SELECT id, " + ", ".join(f"{_zs(c)} AS {c}" for c in ("x", "y", "density", "vx", "vy", "pressure")) + f" FROM ({_STATE})")
def s8(s, d):
    return _state(s, d).select("id", *[_z(c).alias(c) for c in ("x", "y", "density", "vx", "vy", "pressure")])


_SLOPE = f"CASE WHEN dist < {H} THEN {10 / (7 * math.pi * H**4)!r} * (-3 + 2.25 * dist / {H}) ELSE -0.75 * {10 / (7 * math.pi * H**4)!r} * (2 - dist / {H}) ** 2 / (dist / {H}) END"


@query("R1_R2_R3_particle_rates", f"""WITH {EDGES}, g AS (SELECT a.id, a.density AS ad, b.density AS bd, a.pressure AS ap, b.pressure AS bp, b.mass AS bm, a.vx - b.vx AS dvx, a.vy - b.vy AS dvy, dx, dy, {_SLOPE} AS g
FROM e JOIN p a ON a.id = e.a JOIN p b ON b.id = e.b WHERE e.a <> e.b),
t AS (SELECT id, sum(ad * bm / bd * (dvx * dx + dvy * dy) * g) AS r, sum(-bm * (ap / (ad * ad) + bp / (bd * bd)) * g * dx) AS px, sum(-bm * (ap / (ad * ad) + bp / (bd * bd)) * g * dy) AS py,
sum(2 * {NU} * bm / bd * g * dvx) AS sx, sum(2 * {NU} * bm / bd * g * dvy) AS sy FROM g GROUP BY id)
SELECT p.id, {_zs('coalesce(r, 0)', 4)} AS density_rate, {_zs('coalesce(px, 0)', 4)} AS pressure_x, {_zs('coalesce(py, 0)', 4)} AS pressure_y, {_zs('coalesce(px + sx, 0)', 4)} AS total_x, {_zs('coalesce(py + sy, 0)', 4)} AS total_y FROM p LEFT JOIN t USING (id)""")
def r1(s, d):
    got = particles.rates(_edges(s, d, particles.STATE), _state(s, d), H, NU)
    return got.select("id", *[_z(c, 4).alias(c) for c in ("density_rate", "pressure_x", "pressure_y", "total_x", "total_y")])


_MOMENTS = f"""m AS (SELECT a AS id, count(*) FILTER (a <> b) AS neighbours, stddev_pop(dist) FILTER (a <> b) / avg(dist) FILTER (a <> b) AS cv, sum(w) AS moment0,
coalesce(sum(w * dx) FILTER (a <> b), 0) AS x, coalesce(sum(w * dy) FILTER (a <> b), 0) AS y, coalesce(sum(w * dx * dx) FILTER (a <> b), 0) AS cxx, coalesce(sum(w * dx * dy) FILTER (a <> b), 0) AS cxy, coalesce(sum(w * dy * dy) FILTER (a <> b), 0) AS cyy
FROM (SELECT *, (1 - dist / {SUPPORT}) ** 2 AS w FROM e) GROUP BY 1),
v AS (SELECT *, (cxx + cyy - sqrt((cxx - cyy) ** 2 + 4 * cxy * cxy)) / 2 AS low, (cxx + cyy + sqrt((cxx - cyy) ** 2 + 4 * cxy * cxy)) / 2 AS high FROM m)"""


@query("R4_particle_geometry", f"WITH {EDGES}, {_MOMENTS} SELECT id, neighbours, round(cv, 6) AS distance_cv, round(moment0, 6) AS moment0, round(sqrt(x * x + y * y), 7) AS first_moment, {_zs('low', 8)} AS low, {_zs('high', 8)} AS high, low > {particles.RANK_EPS!r} * greatest(1, cxx + cyy) AS full_rank FROM v")
def r4(s, d):
    g = particles.neighbourhood(_edges(s, d), SUPPORT)
    return g.select("id", "neighbours", _r("distance_cv").alias("distance_cv"), _r("moment0").alias("moment0"), F.round("first_moment", 7).alias("first_moment"), _z("low", 8).alias("low"), _z("high", 8).alias("high"), "full_rank")


@query("R6_case_admission", f"""WITH {EDGES}, {_MOMENTS}, c AS (SELECT id % 25 AS case_id, neighbours >= 3 AS enough, low > {particles.RANK_EPS!r} * greatest(1, cxx + cyy) AS ranked, moment0 > 0 AS weighted FROM v)
SELECT case_id, count(*) AS particles, bool_and(enough) AS enough, bool_and(ranked) AS ranked, bool_and(weighted) AS weighted, bool_and(enough AND ranked AND weighted) AS admitted FROM c GROUP BY 1""")
def r6(s, d):
    g = particles.neighbourhood(_edges(s, d), SUPPORT).select((F.col("id") % 25).alias("case_id"), (F.col("neighbours") >= 3).alias("enough"), F.col("full_rank").alias("ranked"), (F.col("moment0") > 0).alias("weighted"))
    return particles.admitted(g, "case_id", ["enough", "ranked", "weighted"])


_SCALES = [0.75, 1.0, 1.25]


@query("R5_P8_scale_features", f"""WITH {EDGES}, l AS (SELECT a AS id, {", ".join(f"sum((1 - dist / ({SUPPORT} * {m} / 1.25)) ** 2) FILTER (dist < {SUPPORT} * {m} / 1.25) AS l{i}" for i, m in enumerate(_SCALES))} FROM e GROUP BY 1)
SELECT id, round(l0, 5) AS f0, round(l1, 5) AS f1, {_zs('l1 - l0', 5)} AS f2, {_zs('(l1 - l0) / ln(1.0 / 0.75)', 5)} AS f3, round(l2, 5) AS f4, {_zs('l2 - l1', 5)} AS f5, {_zs('(l2 - l1) / ln(1.25)', 5)} AS f6 FROM l""")
def r5(s, d):
    def response(m: float):
        reach = SUPPORT * m / 1.25
        w = 1 - F.col("distance") / reach
        return F.sum(F.when(F.col("distance") < reach, w * w))

    # All scales in one sum over a particle's edges.
    by = _edges(s, d).groupBy(F.col("a").alias("id")).agg(*[response(m).alias(f"l{i}") for i, m in enumerate(_SCALES)])
    long = by.select("id", F.inline(F.array(*[F.struct(F.lit(m).alias("scale"), F.col(f"l{i}").alias("v")) for i, m in enumerate(_SCALES)])))
    f = particles.responses(long, "id", _SCALES, "v")
    return f.select("id", *[_z(F.col("features")[i], 5).alias(f"f{i}") for i in range(7)])


# Aggregates and order ----------------------------------------------------------------------------------------------


@query("A11_inner_fold_error", f"WITH {ROWS} SELECT fold, round(avg(e), 6) AS energy FROM (SELECT fold, family, avg(e) AS e FROM (SELECT fold, family, case_id, avg(y * y) AS e FROM rows GROUP BY ALL) GROUP BY ALL) GROUP BY fold")
def a11(s, d):
    return hierarchy.cell_mean(rows(s, d).withColumn("e", F.col("y") * F.col("y")), "e").groupBy("fold").agg(_r(nulls.strict_mean("e")).alias("energy"))


@query("W8_order_statistic", f"WITH {ROWS}, o AS (SELECT family, y, row_number() OVER (PARTITION BY family ORDER BY y) AS i, count(*) OVER (PARTITION BY family) AS n FROM rows) SELECT family, y AS value FROM o WHERE i = (95 * n + 99) // 100")
def w8(s, d):
    # Distinct values with counts instead of sorted rows, so no task holds a family.
    c = rows(s, d).groupBy("family", "y").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("family")
    run = c.select("family", "y", F.sum("c").over(w.orderBy("y")).alias("upto"), F.sum("c").over(w).alias("n"))
    return run.filter(F.col("upto") >= F.floor((95 * F.col("n") + 99) / 100)).groupBy("family").agg(F.min("y").alias("value"))


@query("W11_greedy_folds")
def w11(s, d):
    """Customers to six folds by their number of orders."""
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return selection.greedy_folds(table(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0))), "c_custkey", "orders", 6)


@query("W12_balanced_select")
def w12(s, d):
    """96 parts, balanced over brand, type and size band."""
    return selection.balanced_select(table(s, d, "part").select("p_partkey", "p_brand", "p_type", F.floor(F.col("p_size") / 10).alias("band")), "p_partkey", ["p_brand", "p_type", "band"], 96)


@query("G5_blind_choice", f"""WITH {ROWS}, m AS (SELECT flag AS candidate, fold, avg(y) AS y, avg(n) AS n, avg(b) AS b FROM rows GROUP BY ALL), k AS (SELECT candidate, fold, (y + n + b) / 3 AS m FROM m),
w AS (SELECT k.candidate, count(*) FILTER (k.m < r.m) AS folds_won FROM k JOIN k r ON r.fold = k.fold AND r.candidate = 'N' GROUP BY 1), t AS (SELECT candidate, avg(y) AS y, avg(n) AS n, avg(b) AS b FROM m GROUP BY 1),
o AS (SELECT t.candidate, folds_won, (t.y < r.y)::BIGINT + (t.n < r.n)::BIGINT + (t.b < r.b)::BIGINT AS gains, row_number() OVER (ORDER BY t.y, t.candidate) + row_number() OVER (ORDER BY t.n, t.candidate) + row_number() OVER (ORDER BY t.b, t.candidate) AS rank_sum FROM t JOIN w USING (candidate), t r WHERE r.candidate = 'N'),
l AS (SELECT *, candidate <> 'N' AND folds_won >= 3 AND gains >= 1 AS eligible FROM o)
SELECT *, row_number() OVER (ORDER BY CASE WHEN eligible THEN 0 WHEN candidate = 'N' THEN 1 ELSE 2 END, CASE WHEN eligible THEN rank_sum END, candidate) = 1 AS chosen FROM l""")
def g5(s, d):
    m = rows(s, d).groupBy(F.col("flag").alias("candidate"), "fold").agg(*[nulls.strict_mean(v).alias(v) for v in "ynb"])
    return selection.blind_choice(m, "N", ["y", "n", "b"], 3, 1)


# Composite statistics and decisions ----------------------------------------------------------------------------------


def _quarters(a: str, b: str) -> list:
    return [vectors.diff_sq(F.slice(a, i, 16), F.slice(b, i, 16)) for i in (1, 17, 33, 49)]


_Q = [f"list_distance(q.x[{i}:{i + 15}], t.x[{i}:{i + 15}]) ** 2" for i in (1, 17, 33, 49)]


@query("N13_group_domination", f"WITH {PTS}, {knn_sql()}, g AS (SELECT query, greatest({', '.join(_Q)}) AS top, {' + '.join(_Q)} AS total FROM knn JOIN pts q ON q.row_id = query JOIN pts t ON t.row_id = neighbour) SELECT query, round(avg(CASE WHEN total > 0 THEN top / total END), 6) AS domination FROM g GROUP BY query")
def n13(s, d):
    p = points(s, d)
    e = neighbours(p).join(p.select(F.col("row_id").alias("query"), F.col("x").alias("qx")), "query").join(p.select(F.col("row_id").alias("neighbour"), "x"), "neighbour")
    parts = e.select("query", *[g.alias(f"g{i}") for i, g in enumerate(_quarters("qx", "x"))])
    total = F.col("g0") + F.col("g1") + F.col("g2") + F.col("g3")
    return parts.groupBy("query").agg(_r(F.avg(F.when(total > 0, F.greatest("g0", "g1", "g2", "g3") / total))).alias("domination"))


@query("N17_polarization_replication", f"WITH {ROWS}, o AS (SELECT family, avg(n) > avg(b) AS above FROM fams GROUP BY family) SELECT family, any_value(above) AS above, count(*) AS folds, count(*) FILTER ((n > b) = above) AS agreeing, count(*) FILTER ((n > b) = above) = count(*) AS replicated FROM fams JOIN o USING (family) GROUP BY family")
def n17(s, d):
    f = hierarchy.balanced(rows(s, d), "n", "b", upto="family")
    o = f.groupBy("family").agg((nulls.strict_mean("n") > nulls.strict_mean("b")).alias("above"))
    same = (F.col("n") > F.col("b")) == F.col("above")
    return f.join(o, "family").groupBy("family").agg(F.first("above").alias("above"), F.count(F.lit(1)).alias("folds"), F.count_if(same).alias("agreeing"), (F.count_if(same) == F.count(F.lit(1))).alias("replicated"))


_LABELS = {"both_zero": "n = 0 AND b = 0", "base_zero": "n > 0 AND b = 0", "gain_zero": "n = 0 AND b > 0", "worse": "n > b AND b > 0"}


@query("N19_D4_mechanism_labels", f"WITH {ROWS}, c AS (" + " UNION ALL ".join(f"SELECT family, '{k}' AS label, count(*) FILTER ({v}) AS hits, count(*) AS total FROM cases GROUP BY family" for k, v in _LABELS.items()) + ") SELECT *, CASE WHEN total > 0 AND hits >= 0.5 * total THEN 'DOMINANT' WHEN hits > 0 THEN 'SUPPORTED' ELSE 'INCONCLUSIVE' END AS verdict FROM c")
def n19(s, d):
    return decisions.labelled_counts(hierarchy.case_mean(rows(s, d), "n", "b"), ["family"], {k: F.expr(v) for k, v in _LABELS.items()})


@query("D3_evaluability", f"WITH {ROWS}, m AS (SELECT family, avg(n) AS n, avg(b) AS b, max(CASE WHEN b > 0 THEN n / b END) AS bound FROM fams GROUP BY family) SELECT family, round(n / b, 6) AS ratio, round(bound, 6) AS bound, CASE WHEN b IS NULL OR b <= 0 OR n IS NULL OR bound IS NULL THEN 'NOT_EVALUABLE' WHEN n / b < 0.9 AND bound < 0.9 THEN 'QUALIFIED' ELSE 'NOT_QUALIFIED' END AS verdict FROM m")
def d3(s, d):
    m = hierarchy.balanced(rows(s, d), "n", "b", upto="family").groupBy("family").agg(nulls.strict_mean("n").alias("n"), nulls.strict_mean("b").alias("b"), F.max(F.when(F.col("b") > 0, F.col("n") / F.col("b"))).alias("bound"))
    return m.select("family", _r(F.col("n") / F.col("b")).alias("ratio"), _r("bound").alias("bound"), decisions.evaluability(F.col("n"), F.col("b"), F.col("bound"), 0.9).alias("verdict"))


_NS = "CASE WHEN b > 0 THEN 'EVALUABLE' WHEN n > 0 THEN 'UNBOUNDED' ELSE 'NO_CONTRAST' END"


@query("D5_metric_candidates", f"""WITH {ROWS}, a AS (SELECT avg(CASE WHEN b > 0 THEN n / b END) AS v, CASE WHEN count(*) FILTER (n = 0 AND b = 0) > 0 THEN 'NO_CONTRAST' WHEN count(*) FILTER (n > 0 AND b = 0) > 0 THEN 'UNBOUNDED' ELSE 'EVALUABLE' END AS status FROM rows),
w AS (SELECT avg(n) AS n, avg(b) AS b FROM folds), c AS (SELECT avg(n) AS n, avg(b) AS b FROM cases)
SELECT 'A' AS candidate, round(CASE WHEN status = 'EVALUABLE' THEN v END, 6) AS value, status FROM a UNION ALL SELECT 'B', round(CASE WHEN b > 0 THEN n / b END, 6), {_NS} FROM c
UNION ALL SELECT 'C', round(CASE WHEN b > 0 THEN n / b END, 6), {_NS} FROM w UNION ALL SELECT 'D', round(n / 0.05, 6), 'EVALUABLE' FROM w""")
def d5(s, d):
    return decisions.metric_candidates(rows(s, d), 0.05).withColumn("value", _r("value"))


_FAMILIES = {"joint": "nby", "pair": "nb", "single": "y"}


@query("B9_bound_families", f"""WITH {ROWS}, {DRAWS}, {OCC}, r AS (SELECT replicate, 'n' AS component, n AS stat FROM occ UNION ALL SELECT replicate, 'b', b FROM occ UNION ALL SELECT replicate, 'y', y FROM occ),
p AS (SELECT 'n' AS component, avg(n) AS theta FROM fams UNION ALL SELECT 'b', avg(b) FROM fams UNION ALL SELECT 'y', avg(y) FROM fams),
se AS (SELECT component, stddev_samp(stat) AS se FROM r GROUP BY 1), f(bounds, component) AS (VALUES {", ".join(f"('{k}', '{c}')" for k, v in _FAMILIES.items() for c in v)}),
t AS (SELECT bounds, replicate, max((theta - stat) / se) AS t FROM r JOIN p USING (component) JOIN se USING (component) JOIN f USING (component) GROUP BY ALL),
c AS (SELECT bounds, greatest(0, list_sort(list(t))[{_AT}]) AS critical FROM t GROUP BY bounds)
SELECT bounds, component, round(theta, 6) AS theta, round(critical, 5) AS critical, round(theta + critical * se, 6) AS bound FROM f JOIN p USING (component) JOIN se USING (component) JOIN c USING (bounds)""")
def b9(s, d):
    c = hierarchy.case_mean(rows(s, d), "y", "n", "b")
    r = bootstrap.long_stats(bootstrap.occurrence_weighted(c, REPLICATES, SEED, "nby"), "nby")
    theta = hierarchy.balanced(rows(s, d), "n", "b", "y", upto="family").agg(*[nulls.strict_mean(v).alias(v) for v in "nby"])
    out = None
    for name, members in _FAMILIES.items():
        p = theta.select(F.inline(F.array(*[F.struct(F.lit(v).alias("component"), F.col(v).alias("theta")) for v in members])))
        one = bootstrap.max_t(p, r.filter(F.col("component").isin(*members)), REPLICATES).select(F.lit(name).alias("bounds"), "component", _r("theta").alias("theta"), F.round("critical", 5).alias("critical"), _r("bound").alias("bound"))
        out = one if out is None else out.unionByName(one)
    return out


# Models ----------------------------------------------------------------------------------------------------------

_BASE = list(range(1, 17))
_GROUPS = {"g1": list(range(17, 33)), "g2": list(range(33, 49)), "g3": list(range(49, 65))}


def _moments(s, d) -> dict:
    return models.moments(points(s, d).select("fold", F.concat(F.array(F.lit(1.0)), "x", F.array("y")).alias("z")), "fold", "z")


@query("M7_P14_group_ablation")
def m7(s, d):
    """Cross-fitted ridge error of each design; one pass of moments serves all."""
    got = models.ablation(_moments(s, d), models.designs(_BASE, _GROUPS), 65)
    return s.createDataFrame([(a, b, round(c, 6)) for a, b, c in got], "design string, columns long, error double")


@query("M6_residual_increment")
def m6(s, d):
    """Cross-fitted error of predicting the size of the neighbours' residual from the distances, without and with the norm as proxy."""
    p = points(s, d)
    e = neighbours(p).join(p.select(F.col("row_id").alias("neighbour"), F.col("y").alias("ny")), "neighbour").groupBy(F.col("query").alias("row_id")).agg(F.avg("ny").alias("k"), F.avg("distance").alias("near"), F.max("distance").alias("far"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    z = e.join(p, "row_id").select("fold", F.array(F.lit(1.0), "near", "far", norm, F.abs(F.col("k") - F.col("y"))).alias("z"))
    got = models.ablation(models.moments(z, "fold", "z"), {"scalars": [1, 2], "scalars+proxy": [1, 2, 3]}, 4)
    return s.createDataFrame([(a, b, round(c, 6), round(got[0][2] - c, 6)) for a, b, c in got], "design string, columns long, error double, gain double")


@query("M8_solver_preflight")
def m8(s, d):
    """Condition numbers of each training set's normal matrix, and the error of a solve with a known answer."""
    by = _moments(s, d)
    got = [(f, models.solver_preflight(sum(m for k, m in by.items() if k != f), list(range(1, 65)))) for f in sorted(by)]
    return s.createDataFrame([(f, g["condition"], g["condition_alpha"], int(g["alpha_lost"]), g["error"] < 1e-9) for f, g in got], "fold long, condition double, condition_alpha double, alpha_lost long, exact boolean")


# Content and integrity ---------------------------------------------------------------------------------------------

_TABLES = {"customer": ("input", "c_custkey, c_nationkey, c_mktsegment"), "orders": ("input", "o_orderkey, o_custkey, o_orderstatus"), "supplier": ("lookup", "s_suppkey, s_name, s_nationkey")}


def _hash_sql(cols: str) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce({c.strip()}::VARCHAR, chr(0))" for c in cols.split(",")) + ")"
    return f"count(*) AS rows, sum(('0x' || substr(sha256({text}), 1, 8))::BIGINT)::BIGINT AS digest"


def _manifest_sql(tables: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS name, '{role}' AS role, '{cols.replace(', ', ',')}' AS columns, {_hash_sql(cols)} FROM {t}" for t, (role, cols) in tables.items())


def _tables(s, d) -> dict:
    return {t: (role, table(s, d, t).select(*cols.split(", "))) for t, (role, cols) in _TABLES.items()}


@query("I4_K4_manifest", _manifest_sql(_TABLES))
def i4(s, d):
    return publish.manifest(_tables(s, d))


_FROZEN = {"customer": ("input", "c_custkey, c_nationkey, c_mktsegment"), "orders": ("input", "o_custkey, o_orderkey, o_orderstatus"), "part": ("input", "p_partkey, p_brand")}


@query("I1_hash_gate", f"WITH m AS ({_manifest_sql(_TABLES)}), z AS ({_manifest_sql(_FROZEN)}) SELECT name, CASE WHEN m.rows IS NULL THEN 'MISSING' WHEN z.rows IS NULL THEN 'UNREGISTERED' WHEN m.rows = z.rows AND m.digest = z.digest THEN 'OK' ELSE 'CHANGED' END AS status FROM m FULL JOIN z USING (name)")
def i1(s, d):
    frozen = publish.manifest({t: (role, table(s, d, t).select(*cols.split(", "))) for t, (role, cols) in _FROZEN.items()})
    return publish.hash_gate(publish.manifest(_tables(s, d)), frozen)


@query("I3_release_revalidation", f"WITH {ROWS}, t AS (SELECT fold, avg(y) AS y FROM fams GROUP BY fold) SELECT fold, round(folds.y, 6) AS stated, round(t.y, 6) AS recomputed, abs(folds.y - t.y) <= 1e-9 AS same FROM folds JOIN t USING (fold)")
def i3(s, d):
    r = rows(s, d)
    stated = hierarchy.balanced(r, "y", upto="fold").withColumnRenamed("y", "_y")
    again = hierarchy.balanced(r, "y", upto="family").groupBy("fold").agg(nulls.strict_mean("y").alias("y"))
    return stated.join(again, "fold").select("fold", _r("_y").alias("stated"), _r("y").alias("recomputed"), (F.abs(F.col("_y") - F.col("y")) <= 1e-9).alias("same"))


_FAULTS = """faulty AS (SELECT query, rank, CASE WHEN query % 17 = 3 AND rank = 1 THEN query WHEN query % 19 = 4 AND rank = 2 THEN first WHEN query % 29 = 6 AND rank = 5 THEN -1 ELSE neighbour END AS neighbour,
  CASE WHEN query % 23 = 5 AND rank = 4 THEN distance / 2 ELSE distance END AS distance FROM (SELECT *, min(neighbour) FILTER (rank = 1) OVER (PARTITION BY query) AS first FROM knn) WHERE NOT (query % 31 = 7 AND rank = 10))"""


@query("I7_planted_faults", f"""WITH {PTS}, {knn_sql()}, {_FAULTS}, j AS (SELECT f.*, lag(distance) OVER (PARTITION BY query ORDER BY rank) AS p FROM faulty f),
m AS (SELECT j.*, q.row_id IS NULL OR t.row_id IS NULL AS unknown, q.case_id = t.case_id OR q.fold = t.fold OR (q.seed <> 0 AND q.seed = t.seed) AS alike FROM j LEFT JOIN pts q ON q.row_id = query LEFT JOIN pts t ON t.row_id = neighbour),
b AS (SELECT query, count(*) AS n, count(*) FILTER (unknown) AS unknown, count(*) FILTER (NOT unknown AND alike) AS illegal, count(*) - count(DISTINCT neighbour) AS repeated, count(*) FILTER (distance < p) AS falling, (list_sort(list(rank)) <> range(1, {K + 1}))::BIGINT AS short FROM m GROUP BY query)
SELECT sum(n)::BIGINT AS edges, count(*) AS queries, sum(unknown)::BIGINT AS unknown, sum(illegal)::BIGINT AS illegal, sum(repeated)::BIGINT AS repeated, sum(falling)::BIGINT AS falling, sum(short)::BIGINT AS short FROM b""")
def i7_faults(s, d):
    """A neighbour table with faults of each kind put in, all of which are counted."""
    p = points(s, d)
    e = neighbours(p).withColumn("first", F.min(F.when(F.col("rank") == 1, F.col("neighbour"))).over(Window.partitionBy("query")))
    mod = lambda n, v, r: (F.col("query") % n == v) & (F.col("rank") == r)
    other = F.when(mod(17, 3, 1), F.col("query")).when(mod(19, 4, 2), F.col("first")).when(mod(29, 6, 5), -1).otherwise(F.col("neighbour"))
    bad = e.filter(~mod(31, 7, 10)).select("query", "rank", other.alias("neighbour"), F.when(mod(23, 5, 4), F.col("distance") / 2).otherwise(F.col("distance")).alias("distance"))
    return decisions.edge_faults(bad, p.select("row_id", "case_id", F.col("fold").alias("lineage"), "seed"), K)


@query("I3_planted_faults", f"""WITH {ROWS}, stated AS (SELECT fold, CASE WHEN fold = 2 THEN y + 1e-6 ELSE y END AS y FROM folds WHERE fold <> 4 UNION ALL SELECT 9, 1.0)
SELECT fold, round(s.y, 6) AS stated, round(f.y, 6) AS recomputed, CASE WHEN s.y IS NULL THEN 'MISSING' WHEN f.y IS NULL THEN 'UNKNOWN' WHEN abs(s.y - f.y) <= 1e-9 THEN 'OK' ELSE 'CHANGED' END AS status FROM stated s FULL JOIN folds f USING (fold)""")
def i3_faults(s, d):
    """Stated means, of which one is changed, one left out and one of no rows, against a weighted sum over rows."""
    r = rows(s, d)
    stated = hierarchy.balanced(r, "y", upto="fold").filter("fold <> 4").select("fold", F.when(F.col("fold") == 2, F.col("y") + 1e-6).otherwise(F.col("y")).alias("y"))
    stated = stated.unionByName(s.createDataFrame([(9, 1.0)], "fold long, y double"))
    return decisions.restated(stated, r, "y").select("fold", _r("stated").alias("stated"), _r("recomputed").alias("recomputed"), "status")


@query("J4_orders_without_large_lines", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 30)")
def j4_large(s, d):
    large = table(s, d, "lineitem").filter("l_quantity >= 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey", "o_custkey").join(large, "o_orderkey", "left_anti")


@query("I9_conservation", f"WITH {ROWS} SELECT family, count(*) FILTER (b = 0) AS total, count(*) FILTER (b = 0 AND n = 0) AS a, count(*) FILTER (b = 0 AND n > 0) AS b, count(*) FILTER (b = 0) = count(*) FILTER (b = 0 AND n = 0) + count(*) FILTER (b = 0 AND n > 0) AS conserved FROM rows GROUP BY family")
def i9(s, d):
    zero = F.col("b") == 0
    g = rows(s, d).groupBy("family").agg(F.count_if(zero).alias("total"), F.count_if(zero & (F.col("n") == 0)).alias("a"), F.count_if(zero & (F.col("n") > 0)).alias("b"))
    return g.withColumn("conserved", F.col("total") == F.col("a") + F.col("b"))


@query("F14_P15_json_fallback", "SELECT event_type, count(*) AS n, sum(coalesce(json_extract_string(props, '$.absent.k'), json_extract_string(props, '$.k'))::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def f14(s, d):
    k = F.coalesce(F.get_json_object("props", "$.absent.k"), F.get_json_object("props", "$.k")).cast("long")
    return table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("F15_F16_K10_exact_floats", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_tax = l_discount) AS equal, count(*) FILTER (l_tax = l_discount AND (l_tax <> 0 OR l_tax::VARCHAR = l_discount::VARCHAR)) AS same_bits, count(*) FILTER (abs(l_tax - l_discount) <= 0.011) AS close, count(*) FILTER (l_extendedprice::VARCHAR::DOUBLE = l_extendedprice) AS read_back FROM lineitem GROUP BY 1")
def f15(s, d):
    a, b, x = F.col("l_tax"), F.col("l_discount"), F.col("l_extendedprice")
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("equal"), F.count_if(publish.same_bits(a, b)).alias("same_bits"), F.count_if(F.abs(a - b) <= 0.011).alias("close"), F.count_if(publish.exact_text(x).cast("double") == x).alias("read_back"))
