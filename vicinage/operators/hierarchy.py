"""Balanced aggregation over case, lineage, family and fold.

A mean is null if any of its members is null, NaN or infinite, at every level;
nothing is skipped.  Empty input gives no rows, and one null where there are no
keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import finite, strict_mean

LEVELS = ("case_id", "lineage", "family", "fold")


def case_mean(rows: DataFrame, *values: str) -> DataFrame:
    """Mean of each value by case, with the number of rows."""
    return rows.groupBy("fold", "family", "lineage", "case_id").agg(*[strict_mean(F.col(v)).alias(v) for v in values], F.count(F.lit(1)).alias("rows"))


def balanced(rows: DataFrame, *values: str, upto: str = "all") -> DataFrame:
    """Case, lineage, family, fold: each level's mean counts its members alike.

    ``upto``: ``lineage``, ``family`` or ``fold`` stop at that level's rows.
    """
    out = case_mean(rows, *values).drop("rows")
    for keys in (("fold", "family", "lineage"), ("fold", "family"), ("fold",), ()):
        out = out.groupBy(*keys).agg(*[strict_mean(F.col(v)).alias(v) for v in values])
        if keys and keys[-1] == upto:
            break
    return out


def cell_mean(rows: DataFrame, *values: str) -> DataFrame:
    """Mean over the cases of each fold and family, without the level of lineages."""
    return case_mean(rows, *values).groupBy("fold", "family").agg(*[strict_mean(F.col(v)).alias(v) for v in values], F.count(F.lit(1)).alias("cases"))


def expected_cells(cells: DataFrame, *values: str) -> DataFrame:
    """Every fold with every family; a cell that has no rows has null values, which no mean skips."""
    # A handful of folds and families.
    every = cells.select("fold").distinct().crossJoin(F.broadcast(cells.select("family").distinct()))
    return every.join(cells.select("fold", "family", *values), ["fold", "family"], "left")


def scope_rows(cells: DataFrame, value: str) -> DataFrame:
    """OVERALL, FAMILY and FOLD rows over cells that count alike."""
    grouped = cells.groupingSets([(), ("family",), ("fold",)], "family", "fold").agg(strict_mean(F.col(value)).alias(value), F.grouping("family").alias("gf"), F.grouping("fold").alias("gd"))
    scope = F.when(F.col("gf") == 0, "FAMILY").when(F.col("gd") == 0, "FOLD").otherwise("OVERALL")
    return grouped.select(scope.alias("scope"), F.coalesce("family", F.col("fold").cast("string"), F.lit("ALL")).alias("scope_id"), value)


def without(rows: DataFrame, level: str, member: Column) -> DataFrame:
    """Rows less one member of a level, for counterfactual means."""
    return rows.filter(F.col(level) != member)


def drop_one(rows: DataFrame, value: str, level: str) -> DataFrame:
    """(members' keys, ``without``): the balanced mean of all rows less one member, for each member of a level.

    ``level``: ``case_id``, ``lineage``, ``family`` (of a fold) or ``fold``.  A member's
    own mean is taken out of its parent, the parent's new mean replaces its old one
    above, and a parent left without members is taken out as well, so all members
    cost one pass and one small join a level.  The last member's mean is null, and
    so is each one that a member which is not finite has a part in.
    """
    chain = {"case_id": ("fold", "family", "lineage", "case_id"), "lineage": ("fold", "family", "lineage"), "family": ("fold", "family"), "fold": ("fold",)}[level]
    at = {4: rows.groupBy("fold", "family", "lineage", "case_id").agg(strict_mean(F.col(value)).alias("v"))}
    for n in (3, 2, 1):
        at[n] = at[n + 1].groupBy(*("fold", "family", "lineage")[:n]).agg(strict_mean(F.col("v")).alias("v"))
    out = at[len(chain)].select(*chain, F.col("v").alias("old"), F.lit(None).cast("double").alias("new"), F.lit(True).alias("gone"))
    for n in range(len(chain) - 1, -1, -1):
        # Sum of the finite members, number of members, members that are not finite.
        bad = ~finite(F.col("v"))
        totals = [F.sum(F.when(bad, 0.0).otherwise(F.col("v"))).alias("s"), F.count(F.lit(1)).alias("c"), F.count_if(bad).alias("bad")]
        own = at[n + 1].groupBy(*chain[:n]).agg(*totals)
        out = out.join(own, list(chain[:n])) if n else out.crossJoin(F.broadcast(own))
        left = F.col("c") - F.col("gone").cast("long")
        bads = F.col("bad") - (~finite(F.col("old"))).cast("long") + (~F.col("gone") & ~finite(F.col("new"))).cast("long")
        moved = F.col("s") - F.when(finite(F.col("old")), F.col("old")).otherwise(0.0) + F.when(~F.col("gone") & finite(F.col("new")), F.col("new")).otherwise(0.0)
        out = out.withColumns({"_new": F.when((left > 0) & (bads == 0), moved / left), "_gone": left == 0})
        if n:
            out = out.join(at[n].withColumnRenamed("v", "_old"), list(chain[:n]))
            out = out.select(*chain, F.col("_old").alias("old"), F.col("_new").alias("new"), F.col("_gone").alias("gone"))
    return out.select(*chain, F.col("_new").alias("without"))
