"""What is wrong in a table of bootstrap draws, by kind.

A draw table has one row a drawn case: (replicate, fold, family, occurrence,
lineage, place, case_id).  In a stratum (fold and family) of m lineages every
replicate has the occurrences 0 to m - 1, each of one lineage of that stratum,
and each with as many places, from 0, as its lineage has cases.

Nulls make a row unknown.  An empty draw table lacks every replicate; an empty
table of cases makes all rows unknown.  Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import bootstrap

_STRATUM = ("fold", "family")
KINDS = ("unknown", "moved", "mixed", "wrong_size", "wrong_places", "wrong_strata", "missing", "repeated")


def case_draws(cases: DataFrame, replicates: int, seed: str, domain: str) -> DataFrame:
    """The draw table, a row an occurrence: (replicate, fold, family, occurrence, entries), entries of (lineage, place, case_id).

    Lineages are drawn by ``bootstrap.draws`` from ``seed``; place p of an
    occurrence takes the case whose place is the hash of (domain, replicate,
    stratum, occurrence, p) modulo the lineage's size.  A lineage's cases come with
    its row, so a draw is shuffled once and its entries never.
    """
    # A lineage's cases are a handful of ids.
    held = cases.groupBy(*_STRATUM, "lineage").agg(F.sort_array(F.collect_list("case_id")).alias("_ids"))
    each = bootstrap.draws(cases, replicates, seed, held)
    head = F.concat(F.concat_ws("|", F.lit(domain), *[F.col(c).cast("string") for c in ("replicate", *_STRATUM, "occurrence")]), F.lit("|"))
    n = F.size("_ids")

    def entry(p: Column) -> Column:
        at = F.conv(F.substring(F.sha2(F.concat("_head", p.cast("string")), 256), 1, 12), 16, 10).cast("long") % n
        return F.struct(F.col("lineage").alias("lineage"), p.alias("place"), F.get("_ids", at.cast("int")).alias("case_id"))

    places = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    return each.withColumn("_head", head).select("replicate", *_STRATUM, "occurrence", F.transform(places, entry).alias("entries"))


def entries(draws: DataFrame) -> DataFrame:
    """(replicate, fold, family, occurrence, lineage, place, case_id): a row an entry."""
    return draws.select("replicate", *_STRATUM, "occurrence", F.inline("entries"))


def draw_faults(draws: DataFrame, cases: DataFrame, replicates: int) -> DataFrame:
    """(rows, unknown, moved, mixed, wrong_size, wrong_places, wrong_strata, missing, repeated): one row of counts.

    Unknown: rows without a case of that id.  Moved: rows whose lineage or
    stratum is not their case's.  Mixed: occurrences of several lineages.  Wrong
    size: occurrences with another number of rows than their lineage has cases.
    Wrong places: occurrences whose places are not those from 0, each once.  Wrong
    strata: strata of a replicate without exactly their occurrences.  Missing:
    replicates from 0 to ``replicates`` - 1 without rows.  Repeated: replicates
    that draw the same as one before (by two 64-bit fingerprints).
    """
    own = cases.select("case_id", *[F.col(c).alias(f"_c_{c}") for c in (*_STRATUM, "lineage")])
    sizes = cases.groupBy(*_STRATUM, "lineage").agg(F.count(F.lit(1)).alias("_size"))
    strata = cases.select(*_STRATUM, "lineage").distinct().groupBy(*_STRATUM).agg(F.count(F.lit(1)).alias("_m"))
    met = draws.join(own, "case_id", "left")
    unknown = F.col("_c_lineage").isNull()
    here = (F.col("fold") == F.col("_c_fold")) & (F.col("family") == F.col("_c_family")) & (F.col("lineage") == F.col("_c_lineage"))
    cell = F.struct("replicate", *_STRATUM, "occurrence", "place", "case_id")
    # Sums of hashes modulo 2^64 as whole decimals: no order, no overflow.
    prints = [F.sum(F.xxhash64(F.lit(seed), F.struct(*_STRATUM, "occurrence", "place", "case_id")).cast("decimal(20,0)")).alias(f"_p{seed}") for seed in (1, 2)]
    by = met.withColumn("_cell", cell).groupBy("replicate", *_STRATUM, "occurrence").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(unknown).alias("unknown"), F.count_if(~unknown & ~F.coalesce(here, F.lit(False))).alias("moved"),
        F.count_distinct("lineage").alias("_lineages"), F.min("lineage").alias("lineage"), F.count_distinct("place").alias("_places"), F.min("place").alias("_first"), F.max("place").alias("_last"), *prints,
    )
    by = by.join(sizes, [*_STRATUM, "lineage"], "left")
    by = by.withColumns({
        "mixed": (F.col("_lineages") != 1).cast("long"),
        "wrong_size": (~F.col("rows").eqNullSafe(F.col("_size"))).cast("long"),
        "wrong_places": F.coalesce(((F.col("_first") != 0) | (F.col("_last") != F.col("rows") - 1) | (F.col("_places") != F.col("rows"))).cast("long"), F.lit(1)),
    })
    counted = ("rows", "unknown", "moved", "mixed", "wrong_size", "wrong_places")
    up = by.groupBy("replicate", *_STRATUM).agg(
        *[F.sum(c).alias(c) for c in counted], F.count(F.lit(1)).alias("_n"), F.min("occurrence").alias("_first"), F.max("occurrence").alias("_last"), *[F.sum(f"_p{s}").alias(f"_p{s}") for s in (1, 2)],
    ).join(strata, list(_STRATUM), "left")
    return _told(up, strata, replicates)


def _told(up: DataFrame, strata: DataFrame, replicates: int) -> DataFrame:
    """The row of counts from those of each stratum of a replicate, whose fingerprints add up to the replicate's."""
    counted = KINDS[:5]
    right = (F.col("_n") == F.col("_m")) & (F.col("_first") == 0) & (F.col("_last") == F.col("_m") - 1)
    up = up.withColumn("_right", F.coalesce(right, F.lit(False)))
    total = strata.agg(F.count(F.lit(1)).alias("_strata"))
    each = up.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("rows", *counted)], F.count_if("_right").alias("_rights"), F.count(F.lit(1)).alias("_seen"), *[F.sum(f"_p{s}").alias(f"_p{s}") for s in (1, 2)])
    # Strata that are wrong, and those of which a replicate has none.
    each = each.crossJoin(F.broadcast(total)).withColumn("wrong_strata", F.greatest(F.col("_seen"), F.col("_strata")) - F.col("_rights"))
    known = (F.col("replicate") >= 0) & (F.col("replicate") < replicates)
    alike = each.groupBy("_p1", "_p2").agg(*[F.sum(c).alias(c) for c in ("rows", *counted, "wrong_strata")], (F.count(F.lit(1)) - 1).alias("repeated"), F.count_if(known).alias("_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return alike.agg(*[zero(F.sum(c)).alias(c) for c in ("rows", *counted, "wrong_strata")], (F.lit(replicates) - zero(F.sum("_known"))).alias("missing"), zero(F.sum("repeated")).alias("repeated")).select("rows", *KINDS)


def occurrence_faults(draws: DataFrame, cases: DataFrame, replicates: int) -> DataFrame:
    """The counts of ``draw_faults`` for a table with a row an occurrence, as of ``case_draws``; no entry and no occurrence is shuffled.

    An occurrence is judged by itself.  What needs the cases is counted first: rows
    by (stratum, lineage, case), occurrences by (stratum, lineage, size).  Draws that
    lie together by lineage leave a task as a row a case, whatever the number of
    replicates.  Occurrences without entries are none.
    """
    own = cases.select("case_id", *[F.col(c).alias(f"_c_{c}") for c in (*_STRATUM, "lineage")])
    sizes = cases.groupBy(*_STRATUM, "lineage").agg(F.count(F.lit(1)).alias("_size"))
    strata = cases.select(*_STRATUM, "lineage").distinct().groupBy(*_STRATUM).agg(F.count(F.lit(1)).alias("_m"))
    kinds = dict(cases.dtypes)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    held = F.transform("entries", lambda e: e["lineage"])
    least = F.array_min(held)
    places = F.sequence(zero, F.size("entries").cast("long") - 1)
    prints = {f"_p{seed}": F.xxhash64(F.lit(seed), F.struct(*_STRATUM, "occurrence"), F.sort_array(F.transform("entries", lambda e: F.struct(e["place"].alias("place"), e["case_id"].alias("case_id"))))) for seed in (1, 2)}
    known = draws.filter(F.size("entries") > 0).withColumns({
        "rows": F.size("entries").cast("long"), "_lineage": least,
        "mixed": F.coalesce(least != F.array_max(held), F.lit(True)).cast("long"),
        "wrong_places": (~F.sort_array(F.transform("entries", lambda e: e["place"])).eqNullSafe(places)).cast("long"),
    } | prints)

    def fact(kind: str, **at: Column) -> Column:
        fields = {"replicate": "long", "lineage": kinds["lineage"], "case_id": kinds["case_id"], "size": "long", "occurrence": "long", "rows": "long", "mixed": "long", "wrong_places": "long", "_p1": "long", "_p2": "long"}
        return F.struct(F.lit(kind).alias("kind"), *[at.get(k, F.lit(None)).cast(t).alias(k) for k, t in fields.items()])

    of = {k: F.col(k) for k in ("replicate", "occurrence", "rows", "mixed", "wrong_places", "_p1", "_p2")}
    whole = F.array(fact("stratum", **of), fact("size", lineage=F.col("_lineage"), size=F.col("rows")))
    each = F.transform("entries", lambda e: fact("case", lineage=e["lineage"], case_id=e["case_id"]))
    facts = known.select(*_STRATUM, F.inline(F.concat(whole, each))).groupBy("kind", *_STRATUM, "replicate", "lineage", "case_id", "size").agg(
        F.count(one).alias("n"), F.min("occurrence").alias("_first"), F.max("occurrence").alias("_last"), *[F.sum(c).alias(c) for c in ("rows", "mixed", "wrong_places")],
        # Fingerprints as whole decimals: no order, no overflow.
        *[F.sum(F.when(F.col("kind") == "stratum", F.col(c).cast("decimal(20,0)"))).alias(c) for c in prints],
    )
    facts = written(facts, "faults")
    here = (F.col("fold") == F.col("_c_fold")) & (F.col("family") == F.col("_c_family")) & (F.col("lineage") == F.col("_c_lineage"))
    unknown = F.col("_c_lineage").isNull()
    total = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("n"))), zero).alias(n)
    by_case = facts.filter("kind = 'case'").join(own, "case_id", "left").agg(total(unknown, "unknown"), total(~unknown & ~F.coalesce(here, F.lit(False)), "moved"))
    by_size = facts.filter("kind = 'size'").join(sizes, [*_STRATUM, "lineage"], "left").agg(total(~F.col("size").eqNullSafe(F.col("_size")), "wrong_size"))
    up = facts.filter("kind = 'stratum'").withColumnRenamed("n", "_n").withColumns(dict.fromkeys(("unknown", "moved", "wrong_size"), zero)).join(strata, list(_STRATUM), "left")
    told = _told(up, strata, replicates).drop("unknown", "moved", "wrong_size")
    # One row each.
    return told.crossJoin(F.broadcast(by_case)).crossJoin(F.broadcast(by_size)).select("rows", *KINDS)
