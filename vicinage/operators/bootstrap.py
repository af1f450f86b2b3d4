"""Lineage-first cluster bootstrap and simultaneous bounds.

Draws come from SHA-256, so every replicate is the same on every engine: in a
stratum (fold and family) with m lineages, occurrence i of replicate r takes the
lineage whose place is the hash of (domain, r, stratum, i) modulo m.  A replicate
that draws a value which is null, NaN or infinite is null.  Empty input gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.nulls import finite, strict_mean
from ..sources.scratch import written


def strata(cases: DataFrame) -> DataFrame:
    """(fold, family, lineage, place, m): lineages numbered within their stratum."""
    one = cases.select("fold", "family", "lineage").distinct()
    w = Window.partitionBy("fold", "family")
    return one.withColumn("place", (F.row_number().over(w.orderBy("lineage")) - 1).cast("long")).withColumn("m", F.count(F.lit(1)).over(w))


def draws(cases: DataFrame, replicates: int, domain: str, held: DataFrame | None = None) -> DataFrame:
    """(replicate, fold, family, occurrence, lineage), and what else ``held``, one row a lineage of a stratum, has; with it, draws of a lineage lie together."""
    spark, placed = cases.sparkSession, strata(cases)
    own = placed.drop("m") if held is None else placed.drop("m").join(held, ["fold", "family", "lineage"]).hint("merge")
    # Spread over all tasks before each lineage's slot meets every replicate.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = placed.select("fold", "family", F.col("place").alias("occurrence"), "m").repartition(tasks, "fold", "family", "occurrence").crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "replicate")))
    text = F.concat_ws("|", F.lit(domain), *[F.col(c).cast("string") for c in ("replicate", "fold", "family", "occurrence")])
    at = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") % F.col("m")
    return slots.withColumn("place", at).drop("m").join(own, ["fold", "family", "place"]).select("replicate", "fold", "family", "occurrence", *[c for c in own.columns if c not in ("fold", "family", "place")])


#: Places of a stratum that one row holds, replicates that it draws, hashes made at a time, and weights that are summed at a time.
CHUNK, TOGETHER, HASHED, WEIGHED = 1 << 18, 500, 1 << 16, 1 << 18


@lru_cache(maxsize=16)
def _numerals(first: int, upto: int) -> list[bytes]:
    """Occurrences ``first`` to ``upto`` as text, which all replicates and strata of a worker share."""
    return [b"%d" % i for i in range(first, upto)]


def _hits(prefix: str, first: int, upto: int, m: int) -> np.ndarray:
    """The places that occurrences ``first`` to ``upto`` take."""
    head, sha = prefix.encode(), hashlib.sha256
    # Whole pieces of HASHED numerals are kept, so a stratum's size does not make new ones.
    numerals = _numerals(first, first + HASHED)[: upto - first]
    digests = b"".join([sha(head + i).digest() for i in numerals])
    return (np.frombuffer(digests, ">u8")[::4].astype(np.uint64) >> np.uint64(16)).astype(np.int64) % m


def _weights(prefix: str, m: int, start: int, held: int) -> np.ndarray:
    """How often one replicate draws each of the places ``start`` to ``start + held`` of a stratum of ``m``."""
    w = np.zeros(held, np.int64)
    for first in range(0, m, HASHED):
        hit = _hits(prefix, first, min(m, first + HASHED), m)
        if held < m:
            hit = hit[(hit >= start) & (hit < start + held)] - start
        w += np.bincount(hit, minlength=held)
    return w


def _drawn_sums(replicates: int, domain: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = {k: b.column(k)[i] for k in b.schema.names}
                fold, family, m, start, block = (at[k].as_py() for k in ("fold", "family", "m", "start", "block"))
                stratum = f"{at['fold_text']}|{at['family_text']}"
                one = at["lineages"].values
                lineage, shared = one.field("lineage").to_numpy(), one.field("shared").to_numpy(zero_copy_only=False).astype(bool)
                values = one.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(one), -1)
                sound = np.isfinite(values)
                values, bad = np.where(sound, values, 0.0), (~sound).astype(np.float64)
                own, elsewhere, ids = np.flatnonzero(~shared), np.flatnonzero(shared), lineage[shared]
                out = []
                upto, step = min(replicates, (block + 1) * TOGETHER), max(1, WEIGHED // len(one))
                for s in range(block * TOGETHER, upto, step):
                    some = range(s, min(upto, s + step))
                    w = np.stack([_weights(f"{domain}|{r}|{stratum}|", m, start, len(one)) for r in some])
                    f = w.astype(np.float64)
                    others = [ids[x > 0].tolist() for x in w[:, elsewhere]]
                    parts = ((w * w).sum(1), w @ lineage, (w[:, own] > 0).sum(1))
                    out += zip(some, [fold] * len(w), [family] * len(w), [m] * len(w), w.sum(1).tolist(), *(x.tolist() for x in parts), others, (f @ values).tolist(), (f @ bad).tolist(), strict=True)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def drawn_sums(lineages: DataFrame, replicates: int, domain: str, values: Sequence[str] = ()) -> DataFrame:
    """(replicate, fold, family, m, drawn, squares, total, own, shared, sums, bad) of the draws, none of which is a row.

    ``lineages`` (fold, family, lineage, values), one row a lineage of a stratum.
    ``sums`` are those of the values over occurrences, ``bad`` counts occurrences
    whose value is null, NaN or infinite, ``squares`` sums the squares of the times
    that lineages were drawn, ``total`` their ids.  ``own``: different lineages
    drawn that lie in no other stratum; ``shared``: the others.

    A task holds up to ``CHUNK`` lineages of one stratum and draws ``TOGETHER``
    replicates; the occurrences of a larger stratum are drawn once for each of its
    chunks.  Only sums are shuffled, replicates by strata.
    """
    spark, key = lineages.sparkSession, ["fold", "family"]
    own = lineages.dropna(subset=[*key, "lineage"])
    w = Window.partitionBy(*key)
    shared = own.groupBy("lineage").agg((F.count(F.lit(1)) > 1).alias("shared"))
    placed = own.join(shared, "lineage").withColumns({"place": F.row_number().over(w.orderBy("lineage")) - 1, "m": F.count(F.lit(1)).over(w)})
    one = F.struct("place", "lineage", "shared", F.array(*[F.col(v).cast("double") for v in values]).cast("array<double>").alias("v"))
    start = (F.floor(F.col("place") / CHUNK) * CHUNK).cast("long").alias("start")
    chunks = written(placed.groupBy(*key, "m", start).agg(F.sort_array(F.collect_list(one)).alias("lineages")), "strata")
    blocks = -(-replicates // TOGETHER)
    dealt = chunks.withColumns({"fold_text": F.col("fold").cast("string"), "family_text": F.col("family").cast("string"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    dealt = dealt.repartition(max(1, chunks.count() * blocks))
    kinds = dict(own.dtypes)
    names = f"replicate long, fold {kinds['fold']}, family {kinds['family']}, m long, drawn long, squares long, total long, own long, shared array<long>, sums array<double>, bad array<double>"
    got = dealt.mapInArrow(_drawn_sums(replicates, domain, to_arrow_schema(spark.createDataFrame([], names).schema)), names)
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(len(values))]).cast("array<double>").alias(c)
    return got.groupBy("replicate", *key).agg(F.max("m").alias("m"), *[F.sum(c).alias(c) for c in ("drawn", "squares", "total", "own")], F.flatten(F.collect_list("shared")).alias("shared"), add("sums"), add("bad"))


def occurrence_weighted(cases: DataFrame, replicates: int, domain: str, values: Sequence[str]) -> DataFrame:
    """(replicate, values): case mean in each drawn lineage, mean in the stratum, mean of strata."""
    lineage = cases.groupBy("fold", "family", "lineage").agg(*[strict_mean(v).alias(v) for v in values])
    cell = drawn_sums(lineage, replicates, domain, values).select("replicate", *[F.when(F.col("bad")[i] == 0, F.col("sums")[i] / F.col("m")).alias(v) for i, v in enumerate(values)])
    return cell.groupBy("replicate").agg(*[strict_mean(v).alias(v) for v in values])


def long_stats(stats: DataFrame, values: Sequence[str]) -> DataFrame:
    """(replicate, component, stat), written, as bounds read it more than once."""
    return written(stats.select("replicate", F.inline(F.array(*[F.struct(F.lit(v).alias("component"), F.col(v).alias("stat")) for v in values]))), "replicates")


def count_weighted(cases: DataFrame, replicates: int, domain: str, value: str) -> DataFrame:
    """(replicate, stat): every case weighs as often as it was drawn; mean of the strata's weighted means."""
    lineage = cases.groupBy("fold", "family", "lineage").agg(F.when(F.count_if(~finite(F.col(value))) == 0, F.sum(value)).alias("v"), F.count(F.lit(1)).alias("n"))
    cell = drawn_sums(lineage, replicates, domain, ["v", "n"]).select("replicate", F.when(F.col("bad")[0] == 0, F.col("sums")[0] / F.col("sums")[1]).alias("v"))
    return cell.groupBy("replicate").agg(strict_mean("v").alias("stat"))


def max_t(points: DataFrame, replicates: DataFrame, n: int, level: float = 0.95) -> DataFrame:
    """(component, theta, se, critical, bound): simultaneous upper bounds.

    ``points`` (component, theta), ``replicates`` (replicate, component, stat).
    The critical value is the order statistic at ceil(level n) of the largest
    standardised shortfall of each replicate, at least 0.
    """
    se = replicates.groupBy("component").agg(F.stddev_samp("stat").alias("se"))
    scaled = replicates.join(points, "component").join(se, "component")
    worst = scaled.groupBy("replicate").agg(F.max(F.when(F.col("se") > 0, (F.col("theta") - F.col("stat")) / F.col("se")).otherwise(0.0)).alias("t"))
    at = -int(-level * n // 1)
    critical = worst.agg(F.greatest(F.lit(0.0), F.sort_array(F.collect_list("t"))[at - 1]).alias("critical"))
    return points.join(se, "component").crossJoin(critical).withColumn("bound", F.col("theta") + F.col("critical") * F.col("se"))


#: The replicate that holds point estimates.
POINT = -1


def simultaneous_bounds(stats: DataFrame, replicates: int, allowed: int | None = None, level: float = 0.95) -> DataFrame:
    """(bounds, component, direction, scale, theta, se, critical, bound, valid, degenerate, status) of all families of bounds in one pass.

    ``stats`` (bounds, component, direction, scale, replicate, stat): ``bounds`` names
    a family, whose components share one critical value; ``direction`` is ``upper``
    or ``lower``, ``scale`` ``identity`` or ``log``; replicate ``POINT`` holds the point
    estimate.  A null, NaN or infinite ``stat`` is invalid, as is one not over 0 on
    the log scale.

    One mask for all components of a family: a replicate in which one is invalid is
    degenerate for all.  More than ``allowed`` (two in a hundred) degenerate
    replicates, or fewer than two valid ones, are NOT_EVALUABLE, and so is a
    component without spread unless all its replicates equal the point.  On the log
    scale a component takes part only if its point is over 0 and its own replicates
    suffice; a point of exactly 0 whose replicates are all 0 is an
    EXACT_ZERO_DOMINANCE with bound 0, any other is NOT_EVALUABLE.  The critical
    value is the order statistic at ceil(level n) of the largest standardised
    deviation of each valid replicate, at least 0.  Empty input gives no rows.
    """
    allowed = replicates // 50 if allowed is None else allowed
    key, one = ["bounds"], ["bounds", "component"]
    sound, log = finite(F.col("stat")), F.col("scale") == "log"
    flat = stats.withColumns({"value": F.when(sound & log & (F.col("stat") > 0), F.log("stat")).when(sound & ~log, F.col("stat")), "zero": sound & (F.col("stat") == 0), "sound": sound})
    points = flat.filter(F.col("replicate") == POINT).select(*one, "direction", "scale", F.col("stat").alias("theta"), F.col("value").alias("point"))
    drawn = flat.filter(F.col("replicate") != POINT).select(*one, "replicate", "value", "zero", "sound")
    own = drawn.groupBy(*one).agg(F.count("value").alias("good"), F.count_if("sound").alias("sound"), F.count_if("zero").alias("zeros"))
    enough = (F.col("sound") >= 2) & (F.lit(replicates) - F.col("sound") <= allowed)
    points = points.join(own, one, "left").withColumns({
        "dominant": log & (F.col("theta") == 0) & enough & (F.col("zeros") == F.col("sound")),
        "eligible": F.coalesce(~log | ((F.col("theta") > 0) & (F.col("good") >= 2) & (F.lit(replicates) - F.col("good") <= allowed)), F.lit(False)),
    })
    part = points.filter("eligible").select(*one, "direction", "point")
    masked = drawn.join(part, one).withColumn("invalid", F.max(F.col("value").isNull() | F.col("point").isNull()).over(Window.partitionBy("bounds", "replicate")))
    counts = masked.groupBy(*key).agg(F.count_distinct(F.when(~F.col("invalid"), F.col("replicate"))).alias("valid"))
    kept = masked.filter(~F.col("invalid"))
    spread = kept.groupBy(*one).agg(F.stddev_samp("value").alias("se"), F.min("value").alias("low"), F.max("value").alias("high"), F.first("point").alias("at"))
    flat_ = F.col("low") == F.col("high")
    spread = spread.select(*one, F.when(flat_, 0.0).otherwise(F.col("se")).alias("se"), (flat_ & (F.col("low") != F.col("at"))).alias("stuck"))
    off = F.when(F.col("direction") == "upper", F.col("point") - F.col("value")).otherwise(F.col("value") - F.col("point"))
    worst = kept.join(spread, one).groupBy(*key, "replicate").agg(F.max(F.when(F.col("se") > 0, off / F.col("se")).otherwise(0.0)).alias("t"))
    # A family has as many rows as there are replicates.
    by = Window.partitionBy(*key)
    ranked = worst.withColumns({"i": F.row_number().over(by.orderBy("t")), "n": F.count(F.lit(1)).over(by)})
    critical = ranked.filter(F.col("i") == F.greatest(F.lit(1), F.ceil(F.lit(level) * F.col("n")))).select(*key, F.greatest(F.lit(0.0), F.col("t")).alias("critical"))
    stuck = spread.groupBy(*key).agg(F.max("stuck").alias("stuck"))
    all_ = points.join(counts, key, "left").join(spread.drop("stuck"), one, "left").join(critical, key, "left").join(stuck, key, "left").withColumn("valid", F.coalesce("valid", F.lit(0)))
    status = F.when(F.col("dominant"), "EXACT_ZERO_DOMINANCE").when(F.col("eligible") & (F.col("valid") >= 2) & (F.lit(replicates) - F.col("valid") <= allowed) & ~F.col("stuck"), "EVALUABLE").otherwise("NOT_EVALUABLE")
    moved = F.col("point") + F.when(F.col("direction") == "upper", 1.0).otherwise(-1.0) * F.col("critical") * F.col("se")

    def told(c: Column, dominant: Column) -> Column:
        return F.when(F.col("status") == "EVALUABLE", c).when(F.col("status") == "EXACT_ZERO_DOMINANCE", dominant)

    valid = F.when(F.col("dominant"), F.col("sound")).when(F.col("eligible"), F.col("valid")).otherwise(0)
    return all_.withColumn("status", status).select(
        *one, "direction", "scale", "theta", told(F.col("se"), F.lit(0.0)).alias("se"), told(F.col("critical"), F.lit(0.0)).alias("critical"),
        told(F.when(log, F.exp(moved)).otherwise(moved), F.lit(0.0)).alias("bound"), valid.alias("valid"), (F.lit(replicates) - valid).alias("degenerate"), "status",
    )
