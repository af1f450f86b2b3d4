"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate.  Lines seen often enough to
reach the spread at all get a HyperLogLog sketch of their sites, merged by
aggregation; where the estimate is near the threshold, sites are counted
exactly.  A boilerplate line stays in the document with the smallest id that
holds it and goes from every other document, so text that is copied across
sites is kept once.  Blank lines are not judged.

Nulls: a null text is empty, a null site is one site of its own, a null id
counts as the largest.  Rows that repeat an id are told apart by their text;
rows alike in both are judged alike.  Empty tables give empty results.  Extra
columns are carried on unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_names, materialize

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: A sketch's estimate within this share of the threshold is followed by an exact count.
NEAR = 0.25
LG_K = 12
_LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64(text).alias("_th")]


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(occurrences, decided): lines that are common enough by count, and the keys that are boilerplate with their first id.

    A line's key is 128 bits of hash.  The count of a line bounds its spread from
    above, so sketches are made for lines with at least ``min_sites`` occurrences only.
    """
    rows = docs.select(*_row_keys(docs, id_col, text_col), F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000")).alias("_site"), F.posexplode(_lines(F.col(text_col))).alias("_pos", "_line")).filter(F.trim("_line") != "")
    seen = rows.select("_id", "_th", "_site", "_pos", F.xxhash64("_line").alias("_k1"), F.xxhash64(F.lit(7), "_line").alias("_k2"))
    # Keys are written before they are joined: with plain tables on both sides, a hot line is split as a skewed join.
    common = materialize(seen.groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_sites).select("_k1", "_k2"), "common_keys")
    held = materialize(seen.hint("merge").join(common, ["_k1", "_k2"]), "common_lines")
    sketch = materialize(held.groupBy("_k1", "_k2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("_spread"), F.min("_id").alias("_first")), "sketches")
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    sure = sketch.filter(F.col("_spread") > high).select("_k1", "_k2", "_first")
    near = sketch.filter((F.col("_spread") >= low) & (F.col("_spread") <= high))
    pairs = held.groupBy("_k1", "_k2", "_site").agg(F.min("_id").alias("_low"))
    exact = pairs.join(near.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_sites"), F.min("_low").alias("_first")).filter(F.col("_sites") >= min_sites)
    return held, materialize(sure.unionByName(exact.select("_k1", "_k2", "_first")), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with the kept text, and ``n_lines`` and ``n_removed`` beside it.

    Where ``docs`` has columns of these names, the two get underscores before
    theirs until they are free; they are the last two columns in any case.
    """
    n_lines, n_removed, key, theirs, gone, lines = free_names(docs, "n_lines", "n_removed", "key", "theirs", "gone", "lines")
    held, decided = boilerplate(docs, min_sites, id_col, text_col, site_col)
    found = held.hint("merge").join(decided, ["_k1", "_k2"]).filter(F.col("_id") != F.col("_first")).groupBy(F.struct("_id", "_th").alias(theirs)).agg(F.collect_set("_pos").alias(gone))
    rows = docs.withColumn(key, F.struct(*_row_keys(docs, id_col, text_col)))
    both = rows.join(found, F.col(key) == F.col(theirs), "left").withColumn(lines, _lines(F.col(text_col)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.col(lines)[i]), "\n"))
    counted = both.withColumn(n_lines, F.size(lines).cast("long")).withColumn(n_removed, F.coalesce(F.size(gone), F.lit(0)).cast("long")).withColumn(text_col, text)
    return counted.select(*docs.columns, n_lines, n_removed)
