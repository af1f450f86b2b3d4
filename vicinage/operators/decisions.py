"""Verdicts from counts and gates, and metric candidates on zero-laden ratios.

A null input gives NOT_EVALUABLE, or does not count as met; empty tables give no
rows, and one row of nulls where there are no keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import finite, strict_mean
from . import hierarchy


def evaluability(n: Column, b: Column, bound: Column, most: float = 1.0) -> Column:
    """QUALIFIED if the ratio and its upper bound lie under ``most``; without a positive base NOT_EVALUABLE."""
    ok = (n / b < most) & (bound < most)
    return F.when(b.isNull() | (b <= 0) | n.isNull() | bound.isNull(), "NOT_EVALUABLE").when(ok, "QUALIFIED").otherwise("NOT_QUALIFIED")


def support(count: Column, total: Column | None = None, share: float = 0.5) -> Column:
    """SUPPORTED if anything was counted, else INCONCLUSIVE; with ``total``, DOMINANT from ``share`` of it on."""
    out = F.when(count > 0, "SUPPORTED").otherwise("INCONCLUSIVE")
    return out if total is None else F.when((total > 0) & (count >= share * total), "DOMINANT").otherwise(out)


def labelled_counts(rows: DataFrame, keys: list[str], predicates: dict[str, Column]) -> DataFrame:
    """(keys, label, hits, total, verdict): how many rows meet each predicate; null does not."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(p, F.lit(False))).alias(f"_{k}") for k, p in predicates.items()])
    long = counts.select(*keys, "total", F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"_{k}").alias("hits")) for k in predicates])))
    return long.withColumn("verdict", support(F.col("hits"), F.col("total"))).select(*keys, "label", "hits", "total", "verdict")


def _quotient(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def _status(n: Column, d: Column) -> Column:
    return F.when(d > 0, "EVALUABLE").when(n > 0, "UNBOUNDED").otherwise("NO_CONTRAST")


def metric_candidates(rows: DataFrame, q2: float) -> DataFrame:
    """(candidate, value, status): A mean of row ratios, B mean over cases of n over that of b, C W(n)/W(b), D W(n)/q2.

    A needs every row: one of no contrast or unbounded makes A so, no contrast
    first.  Negative parts are an error.
    """
    sound = F.when((F.col("n") < 0) | (F.col("b") < 0), F.raise_error("negative n or b").cast("double"))
    rows = rows.withColumn("n", F.coalesce(sound, F.col("n")))
    a = rows.agg(F.avg(_quotient(F.col("n"), F.col("b"))).alias("value"), F.count_if((F.col("b") == 0) & (F.col("n") == 0)).alias("_none"), F.count_if((F.col("b") == 0) & (F.col("n") > 0)).alias("_open"))
    a_status = F.when(F.col("_none") > 0, "NO_CONTRAST").when(F.col("_open") > 0, "UNBOUNDED").otherwise("EVALUABLE")
    a = a.select(F.lit("A").alias("candidate"), F.when(a_status == "EVALUABLE", F.col("value")).alias("value"), a_status.alias("status"))
    cases = hierarchy.case_mean(rows, "n", "b").agg(strict_mean("n").alias("n"), strict_mean("b").alias("b"))
    w = hierarchy.balanced(rows, "n", "b")
    one = lambda df, name, d: df.select(F.lit(name).alias("candidate"), _quotient(F.col("n"), d).alias("value"), _status(F.col("n"), d).alias("status"))
    return a.unionByName(one(cases, "B", F.col("b"))).unionByName(one(w, "C", F.col("b"))).unionByName(one(w, "D", F.lit(float(q2))))


def edge_faults(edges: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(edges, queries, unknown, illegal, repeated, falling, short): one row of counts of what is wrong in a neighbour table.

    ``edges`` (query, rank, neighbour, distance), ``rows`` (row_id, case_id, lineage, seed).
    Unknown: an end that is no row.  Illegal: of the same case or lineage, or of the
    same seed but 0.  Repeated: a neighbour that a query has more than once, counted
    without the first.  Falling: nearer than the rank before.  Short: queries
    without exactly the ranks 1 to k.
    """
    q = rows.select(F.col("row_id").alias("query"), F.col("case_id").alias("_qc"), F.col("lineage").alias("_ql"), F.col("seed").alias("_qs"))
    t = rows.select(F.col("row_id").alias("neighbour"), F.col("case_id").alias("_tc"), F.col("lineage").alias("_tl"), F.col("seed").alias("_ts"))
    before = F.lag("distance").over(Window.partitionBy("query").orderBy("rank"))
    met = edges.withColumn("_p", before).join(q, "query", "left").join(t, "neighbour", "left")
    unknown = F.col("_qc").isNull() | F.col("_tc").isNull()
    alike = (F.col("_qc") == F.col("_tc")) | (F.col("_ql") == F.col("_tl")) | ((F.col("_qs") != 0) & (F.col("_qs") == F.col("_ts")))
    by = met.groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("unknown"), F.count_if(~unknown & alike).alias("illegal"), (F.count(F.lit(1)) - F.count_distinct("neighbour")).alias("repeated"),
        F.count_if(F.col("distance") < F.col("_p")).alias("falling"), ((F.count_distinct("rank") != k) | (F.min("rank") != 1) | (F.max("rank") != k) | (F.count(F.lit(1)) != k)).cast("long").alias("short"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.count(F.lit(1)).alias("queries"), *[total(c) for c in ("unknown", "illegal", "repeated", "falling", "short")])


def restated(stated: DataFrame, rows: DataFrame, value: str, tolerance: float = 1e-9) -> DataFrame:
    """(fold, stated, recomputed, status) of stated balanced means by fold, held against one weighted sum over rows.

    A row weighs one over the members of each of its levels, multiplied, which is
    another way than means of means.  OK, CHANGED, MISSING (not stated),
    UNKNOWN (stated without rows); a value that is not finite makes the sum null.
    """
    levels = ("fold", "family", "lineage", "case_id")
    weighed = rows.withColumn("_w", F.lit(1.0))
    for i in range(1, 4):
        members = rows.select(*levels[: i + 1]).distinct().groupBy(*levels[:i]).agg(F.count(F.lit(1)).alias(f"_m{i}"))
        weighed = weighed.join(members, list(levels[:i])).withColumn("_w", F.col("_w") / F.col(f"_m{i}"))
    size = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("_m4"))
    weighed = weighed.join(size, list(levels)).withColumn("_w", F.col("_w") / F.col("_m4"))
    sums = weighed.groupBy("fold").agg(F.when(F.count_if(~finite(F.col(value))) == 0, F.sum(F.col("_w") * F.col(value))).alias("recomputed"), F.lit(1).alias("_here"))
    both = stated.select("fold", F.col(value).alias("stated"), F.lit(1).alias("_said")).join(sums, "fold", "full_outer")
    same = F.col("stated").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("stated") - F.col("recomputed")) <= tolerance, F.lit(False))
    status = F.when(F.col("_said").isNull(), "MISSING").when(F.col("_here").isNull(), "UNKNOWN").when(same, "OK").otherwise("CHANGED")
    return both.select("fold", "stated", "recomputed", status.alias("status"))
