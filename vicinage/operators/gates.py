"""Absolute and relative gates over the readings of two arms, and the verdicts that follow.

Readings are rows (component, arm, scope, metric, member, value).  ``arm`` is
``base`` or ``new``.  ``scope`` is POINT (member ``ALL``), FOLD or FAMILY (one
row a member), BOUND and FAMILY_BOUND (bounds of the new arm's values) or
RATIO_BOUND (bounds of new over base, in the new arm).

A check is true if every member that is expected has a finite reading within
its limit, false if one lies outside, else null.  A reading that is missing,
null, NaN, infinite or stated twice is not evaluable; it neither passes nor
fails a limit, and its side of the verdict is not evaluable.  An empty table
gives no rows.  Other columns and scopes are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite

#: Differences up to this are rounding.
FLOOR = 128 * 2.0**-52


@dataclass(frozen=True)
class Rules:
    """Limits of one set of gates.

    ``below`` and ``above``: metric to (limit of the point, limit of its bound).
    ``ratios``: metric to limits of new over base.  ``steady``: the metric that
    may not grow.  ``strict``: metrics that must lie under their limits and not on
    them.  ``others``: metrics whose points must be finite and have no limit.
    ``whole``: coverage must be known in every fold, and bases must lie above zero.
    """

    below: dict[str, tuple[float, float]]
    above: dict[str, tuple[float, float]]
    ratios: dict[str, tuple[float, float]]
    steady: str
    strict: tuple[str, ...] = ()
    others: tuple[str, ...] = ()
    whole: bool = False
    family: tuple[float, float] = (0.85, 1.00)
    coverage: tuple[float, float] = (0.90, 0.80)
    steady_growth: tuple[float, float] = (0.02, 1.05)
    most_drop: float = 0.05


# The limits of both sets of gates.
OLDER = Rules(
    below={"dnn_median": (0.20, 0.25), "dnn_p90": (0.50, 0.60), "conditional_variance": (0.25, 0.35), "oracle_nrmse": (0.60, 0.70)},
    above={"improvement": (0.25, 0.15)},
    ratios={"dnn_p90": (0.80, 0.90), "conditional_variance": (0.80, 0.90), "oracle_nrmse": (0.85, 0.95)},
    steady="dnn_median",
    others=("baseline_nrmse",),
)
FRESH = Rules(
    below={"candidate_c": (1.0, 1.0), "conditional_variance": (0.25, 0.35), "oracle_nrmse": (0.60, 0.70)},
    above={"improvement": (0.25, 0.15)},
    ratios={"candidate_c": (0.80, 0.90), "conditional_variance": (0.80, 0.90), "oracle_nrmse": (0.85, 0.95)},
    steady="candidate_c",
    strict=("candidate_c",),
    whole=True,
)


def paired(readings: DataFrame) -> DataFrame:
    """(component, scope, metric, member, base, new): both arms' readings side by side, null where not finite or not stated once."""

    def arm(name: str) -> Column:
        own = F.col("arm") == name
        value = F.max(F.when(own, F.col("value").cast("double")))
        return F.when((F.count_if(own) == 1) & finite(value), value).alias(name)

    return readings.groupBy("component", "scope", "metric", "member").agg(arm("base"), arm("new"))


def _of(scope: str, *metrics: str) -> Column:
    return (F.col("scope") == scope) & F.col("metric").isin(*metrics)


def _every(rows: Column, ok: Column, expected: int) -> Column:
    """True if ``expected`` rows are ok, false if one is not, null if some are missing or unknown."""
    return F.when(F.count_if(rows & ~ok) > 0, False).when(F.count_if(rows & ok) == expected, True)


def _known(rows: Column, value: Column, expected: int) -> Column:
    return F.count_if(rows & value.isNotNull()) == expected


def _checks(r: Rules, folds: int, families: int) -> dict[str, dict[str, Column]]:
    base, new = F.col("base"), F.col("new")
    ratio = F.when(base > 0, new / base)
    point = lambda m, c: F.max(F.when(_of("POINT", m), c))
    absolute, relative = {}, {}
    for m, limits in r.below.items():
        for scope, limit in zip(("POINT", "BOUND"), limits, strict=True):
            absolute[f"{m}_{scope.lower()}"] = _every(_of(scope, m), new < limit if m in r.strict else new <= limit, 1)
    for m, limits in r.above.items():
        for scope, limit in zip(("POINT", "BOUND"), limits, strict=True):
            absolute[f"{m}_{scope.lower()}"] = _every(_of(scope, m), new >= limit, 1)
    family = {s: _every(_of(s, "oracle_nrmse"), new <= limit, families) for s, limit in zip(("FAMILY", "FAMILY_BOUND"), r.family, strict=True)}
    absolute["every_family_point"], absolute["every_family_bound"] = family["FAMILY"], family["FAMILY_BOUND"]
    covered = {s: _every(_of(s, "coverage"), new >= limit, n) for s, limit, n in zip(("POINT", "FAMILY"), r.coverage, (1, families), strict=True)}
    absolute["coverage"], absolute["coverage_every_family"] = covered["POINT"], covered["FAMILY"]
    own = _by_fold(r, r.below)
    absolute["all_folds_valid"] = _known(_of("FOLD", *own), new, folds * len(own))

    for m, (limit, bound) in r.ratios.items():
        relative[f"{m}_ratio"] = _every(_of("POINT", m), ratio <= limit, 1)
        relative[f"{m}_ratio_bound"] = _every(_of("RATIO_BOUND", m), new <= bound, 1)
    growth, times = r.steady_growth
    b, n = point(r.steady, base), point(r.steady, new)
    steady = (n - b <= growth) & ((b <= 100 * FLOOR) | (n / b <= times))
    relative[f"{r.steady}_not_worse"] = steady & (b > 0) if r.steady in r.strict else steady
    worst = lambda c: F.when(_known(_of("FAMILY", "oracle_nrmse"), c, families), F.max(F.when(_of("FAMILY", "oracle_nrmse"), c)))
    relative["worst_family"] = (worst(new) - worst(base) <= r.most_drop) & family["FAMILY"] & family["FAMILY_BOUND"]
    kept = new >= base - r.most_drop
    relative["coverage_kept"] = covered["POINT"] & covered["FAMILY"] & _every(_of("POINT", "coverage"), kept, 1) & _every(_of("FAMILY", "coverage"), kept, families)
    # A fold reverses if all effects are worse there: as many folds as effects are worse for it.
    worse = F.collect_list(F.when(_of("FOLD", *r.ratios) & (new > base + FLOOR), F.col("member")))
    reversed_ = F.exists(F.array_distinct(worse), lambda f: F.size(F.filter(worse, lambda g: g == f)) == len(r.ratios))
    relative["no_reversed_fold"] = F.when(_known(_of("FOLD", *_by_fold(r, r.ratios)), base + new, folds * len(_by_fold(r, r.ratios))), ~reversed_)
    return {"absolute": absolute, "relative": relative}


def _by_fold(r: Rules, metrics: dict) -> list[str]:
    return [*metrics, "coverage"] if r.whole else [*metrics]


def _evaluable(r: Rules, folds: int, families: int) -> dict[str, Column]:
    new, both = F.col("new"), F.col("base") + F.col("new")
    points = [*r.below, *r.above, *r.others, "coverage"]
    bounds = [*r.below, *r.above]
    own = _by_fold(r, r.below)
    alike = list(dict.fromkeys([r.steady, *r.ratios, "coverage"]))
    family_bound = _known(_of("FAMILY_BOUND", "oracle_nrmse"), new, families)
    absolute = _known(_of("POINT", *points), new, len(points)) & _known(_of("BOUND", *bounds), new, len(bounds)) & _known(_of("FAMILY", "oracle_nrmse", "coverage"), new, 2 * families) & family_bound & _known(_of("FOLD", *own), new, folds * len(own))
    relative = _known(_of("POINT", *alike), both, len(alike)) & _known(_of("RATIO_BOUND", *r.ratios), new, len(r.ratios)) & _known(_of("FAMILY", "oracle_nrmse", "coverage"), both, 2 * families) & family_bound & _known(_of("FOLD", *_by_fold(r, r.ratios)), both, folds * len(_by_fold(r, r.ratios)))
    if r.whole:
        relative = relative & (F.count_if(_of("POINT", *r.ratios) & (F.col("base") > 0)) == len(r.ratios))
    return {"absolute": absolute, "relative": relative}


def _sides(readings: DataFrame, r: Rules, folds: int, families: int) -> DataFrame:
    """(component, absolute, relative), each a struct of ``evaluable``, ``passed`` and its ``checks`` by name."""
    checks, evaluable = _checks(r, folds, families), _evaluable(r, folds, families)
    columns = [c.alias(f"{side}_{name}") for side, by in checks.items() for name, c in by.items()]
    got = paired(readings).groupBy("component").agg(*columns, *[c.alias(f"{side}_evaluable") for side, c in evaluable.items()])

    def side(name: str) -> Column:
        own = {k: F.col(f"{name}_{k}") for k in checks[name]}
        passed = F.col(f"{name}_evaluable")
        for c in own.values():
            passed = passed & F.coalesce(c, F.lit(False))
        table = F.array(*[F.struct(F.lit(k).alias("check"), c.alias("passed")) for k, c in own.items()])
        return F.struct(F.col(f"{name}_evaluable").alias("evaluable"), passed.alias("passed"), table.alias("checks")).alias(name)

    return got.select("component", side("absolute"), side("relative"))


def checks(readings: DataFrame, rules: Rules = OLDER, folds: int = 6, families: int = 4) -> DataFrame:
    """(component, side, check, passed): every check of every component; ``passed`` is null where it cannot be told."""
    tree = _sides(readings, rules, folds, families)
    parts = [tree.select("component", F.lit(s).alias("side"), F.inline(F.col(s)["checks"])) for s in ("absolute", "relative")]
    return parts[0].unionByName(parts[1])


def verdicts(readings: DataFrame, rules: Rules = OLDER, folds: int = 6, families: int = 4) -> DataFrame:
    """(component, absolute_evaluable, absolute_passed, relative_evaluable, relative_passed, status) of each component, and of ``ALL``.

    QUALIFIED, ABSOLUTE_ONLY, RELATIVE_ONLY, NOT_QUALIFIED, or NOT_EVALUABLE if
    either side is; ``ALL`` is evaluable if every component is, passes if all do.
    """
    sides = [F.col(s)[v].alias(f"{s}_{v}") for s in ("absolute", "relative") for v in ("evaluable", "passed")]
    each = _sides(readings, rules, folds, families).select("component", *sides)
    names = each.columns[1:]
    total = each.agg(*[F.bool_and(n).alias(n) for n in names]).filter(F.col(names[0]).isNotNull()).select(F.lit("ALL").alias("component"), *names)
    a, r = F.col("absolute_passed"), F.col("relative_passed")
    status = F.when(~F.col("absolute_evaluable") | ~F.col("relative_evaluable"), "NOT_EVALUABLE").when(a & r, "QUALIFIED").when(a, "ABSOLUTE_ONLY").when(r, "RELATIVE_ONLY").otherwise("NOT_QUALIFIED")
    return each.unionByName(total).withColumn("status", status)
