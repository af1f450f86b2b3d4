"""Queries on the whole bootstrap: cases inside lineages, 10,000 different replicates, and the bounds that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import divide, strict_mean
from ..operators import bootstrap, hierarchy, resampling
from ..sources.scratch import written
from .base import query, rows

R = 6
REPLICATES, DOMAIN = 10_000, "case-bootstrap"
#: Least number of lineages of a stratum, and of its effective lineages in a replicate.
LINEAGES, EFFECTIVE = 6, 2.0
#: Two constant predictions of each component, as arms.
ARMS = {"ss": {"y": 25.0, "n": 0.04, "b": 0.05}, "ms": {"y": 26.0, "n": 0.035, "b": 0.045}}
_r = lambda c: F.round(c, R)
_KEY = ["fold", "family"]


def _cases(s, d) -> DataFrame:
    return hierarchy.case_mean(rows(s, d), "y", "n", "b")


@query("B1_B2_case_draws")
def b1(s, d):
    """Cases drawn, different cases and different lineages of every replicate."""
    got = resampling.resample(_cases(s, d), REPLICATES, DOMAIN)
    return got.groupBy("replicate").agg(F.sum("drawn").alias("drawn"), F.sum("cases").alias("cases"), F.sum("lineages").alias("lineages"))


@query("B3_I8_case_draw_gates")
def b3(s, d):
    """Per stratum: lineages, effective lineages of the worst replicate, and whether both suffice and all replicates reach the stratum."""
    got = resampling.resample(_cases(s, d), REPLICATES, DOMAIN)
    by = got.groupBy(*_KEY).agg(F.max("m").alias("members"), F.count(F.lit(1)).alias("replicates"), F.min("ess").alias("ess"), F.count_if(F.col("ess") < EFFECTIVE).alias("failing"))
    return by.select(*_KEY, "members", "replicates", _r("ess").alias("least_ess"), "failing", (F.col("members") >= LINEAGES).alias("enough_lineages"), ((F.col("members") >= LINEAGES) & (F.col("failing") == 0) & (F.col("replicates") == REPLICATES)).alias("admitted"))


def _mean_of_strata(got: DataFrame, columns: list[str]) -> DataFrame:
    return got.groupBy("replicate").agg(*[strict_mean(F.col(c)).alias(c) for c in columns])


@query("B4_case_occurrence_weighted")
def b4(s, d):
    return _mean_of_strata(resampling.resample(_cases(s, d), REPLICATES, DOMAIN, occurrence=["y"]), ["occ_y"]).select("replicate", _r("occ_y").alias("stat"))


@query("B5_case_count_weighted")
def b5(s, d):
    return _mean_of_strata(resampling.resample(_cases(s, d), REPLICATES, DOMAIN, count=["y"]), ["cnt_y"]).select("replicate", _r("cnt_y").alias("stat"))


def with_points(cases: DataFrame, got: DataFrame, values: list[str]) -> DataFrame:
    """Replicates of each stratum, and as replicate ``POINT`` what the cases themselves give."""
    lineage = cases.groupBy(*_KEY, "lineage").agg(*[strict_mean(F.col(v)).alias(f"occ_{v}") for v in values]).groupBy(*_KEY).agg(*[strict_mean(F.col(f"occ_{v}")).alias(f"occ_{v}") for v in values])
    case = cases.groupBy(*_KEY).agg(*[strict_mean(F.col(v)).alias(f"cnt_{v}") for v in values])
    both = lineage.join(case, _KEY).withColumn("replicate", F.lit(bootstrap.POINT).cast("long")).withColumns({k: F.col(k).cast("string") for k in _KEY})
    columns = ["replicate", *_KEY, *[f"{k}_{v}" for k in ("occ", "cnt") for v in values]]
    return both.select(*columns).unionByName(got.select(*columns))


def families(strata: DataFrame, names: list[str]) -> DataFrame:
    """(bounds, component, direction, scale, replicate, stat): absolute bounds of both arms, of their errors by family, and paired ratios.

    A ratio is null where its base is not over 0.
    """
    values = [f"{k}_{c}" for k in (*ARMS, "den") for c in "ynb"]
    every = [f"{k}_{v}" for k in ("occ", "cnt") for v in values]
    whole = strata.groupBy("replicate").agg(*[strict_mean(F.col(c)).alias(c) for c in every])
    own = strata.groupBy("replicate", "family").agg(*[strict_mean(F.col(f"cnt_{a}_{c}")).alias(f"{a}_{c}") for a in ARMS for c in "ynb"])
    wide = own.groupBy("replicate").pivot("family", names).agg(*[F.first(f"{a}_{c}").alias(f"{a}_{c}") for a in ARMS for c in "ynb"])
    both = whole.join(wide, "replicate")
    out = []

    def add(bounds: str, c: str, stat, direction: str = "upper", scale: str = "identity") -> None:
        out.append(F.struct(F.lit(bounds).alias("bounds"), F.lit(c).alias("component"), F.lit(direction).alias("direction"), F.lit(scale).alias("scale"), stat.alias("stat")))

    for c in "ynb":
        ratio = {a: divide(F.col(f"occ_{a}_{c}"), F.col(f"occ_den_{c}")) for a in ARMS}
        error = {a: divide(F.sqrt(f"cnt_{a}_{c}"), F.sqrt(f"cnt_den_{c}")) for a in ARMS}
        for a in ARMS:
            add(f"{a}_balanced_ratio", c, ratio[a])
            add(f"{a}_conditional_variance", c, F.col(f"cnt_{a}_{c}"))
            add(f"{a}_nrmse", c, error[a])
            add(f"{a}_improvement", c, 1 - error[a], "lower")
            for f in names:
                add(f"{a}_nrmse_{f}", c, divide(F.sqrt(F.col(f"`{f}_{a}_{c}`")), F.sqrt(f"cnt_den_{c}")))
        add("paired_balanced_ratio", c, divide(ratio["ms"], ratio["ss"]), scale="log")
        add("paired_conditional_variance", c, divide(F.col(f"cnt_ms_{c}"), F.col(f"cnt_ss_{c}")), scale="log")
        add("paired_nrmse", c, divide(error["ms"], error["ss"]), scale="log")
    return both.select("replicate", F.inline(F.array(*out)))


def arm_cases(s, d) -> DataFrame:
    """Cases with squared errors of both arms and squared targets, for each component."""
    squares = {f"{a}_{c}": (F.col(c) - F.lit(at)) * (F.col(c) - F.lit(at)) for a, of in ARMS.items() for c, at in of.items()} | {f"den_{c}": F.col(c) * F.col(c) for c in "ynb"}
    return hierarchy.case_mean(rows(s, d).withColumns(squares), *squares)


def all_bounds(s, d, replicates: int = REPLICATES) -> DataFrame:
    # Lineages, tiles and points are all made of them.
    cases = written(arm_cases(s, d), "cases")
    values = [f"{k}_{c}" for k in (*ARMS, "den") for c in "ynb"]
    got = resampling.resample(cases, replicates, DOMAIN, occurrence=values, count=values)
    # A handful of families, which name columns.
    names = sorted(r[0] for r in got.select("family").distinct().collect())
    stats = written(families(with_points(cases, got, values), names), "statistics")
    return bootstrap.simultaneous_bounds(stats, replicates)


def _rounded(out: DataFrame) -> DataFrame:
    return out.select("bounds", "component", "direction", "scale", *[_r(c).alias(c) for c in ("theta", "se", "bound")], F.round("critical", 5).alias("critical"), "valid", "degenerate", "status")


@query("B6_B7_B8_B9_case_bounds")
def b9(s, d):
    """Every family of bounds by component, in one pass over the replicates."""
    return _rounded(all_bounds(s, d))
