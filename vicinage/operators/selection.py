"""Greedy assignment and selection over classes of interchangeable rows, and blind choice of a candidate."""

from __future__ import annotations

import heapq
from collections import Counter
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_folds(items: DataFrame, key: str, load: str, folds: int, domain: str = "folds") -> DataFrame:
    """``items`` with ``fold``: largest loads first, each to the fold with the least load so far (ties: lowest fold).

    Only the integer loads decide, so the loop on the driver runs over (load,
    count) pairs; rows of one load take the places of their class by hash.  A
    null load counts as 0.
    """
    it = items.withColumn("_load", F.coalesce(F.col(load).cast("long"), F.lit(0)))
    classes = [(r["_load"], r["n"]) for r in it.groupBy("_load").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("_load")).collect()]
    heap = [(0, f) for f in range(folds)]
    places: list[tuple[int, int, int]] = []
    for size, n in classes:
        got: Counter[int] = Counter()
        # Equal loads go round: once all folds are within one item of each other, the rest is dealt evenly.
        while n:
            low, fold = heap[0]
            if n >= folds and max(x for x, _ in heap) - low < max(size, 1):
                each = n // folds
                for f in range(folds):
                    got[f] += each
                heap = [(x + each * size, f) for x, f in heap]
                heapq.heapify(heap)
                n -= each * folds
                continue
            heapq.heapreplace(heap, (low + size, fold))
            got[fold] += 1
            n -= 1
        end = 0
        for fold in sorted(got):
            end += got[fold]
            places.append((size, end, fold))
    table = items.sparkSession.createDataFrame(places, "_size long, _end long, fold long").groupBy("_size").agg(F.sort_array(F.collect_list(F.struct("_end", "fold"))).alias("_places"))
    h = F.sha2(F.concat_ws("|", F.lit(domain), F.col(key).cast("string")), 256)
    ranked = it.withColumn("_at", F.row_number().over(Window.partitionBy("_load").orderBy(h, key)))
    placed = ranked.join(F.broadcast(table), F.col("_load") == F.col("_size"))
    return placed.withColumn("fold", F.filter("_places", lambda p: p["_end"] >= F.col("_at"))[0]["fold"]).drop("_load", "_size", "_places", "_at")


def balanced_select(pool: DataFrame, key: str, axes: list[str], k: int, domain: str = "select") -> DataFrame:
    """(key, axes, step): k rows, each step the one that keeps the axes' loads nearest to even shares.

    After a step each value of an axis should hold its even share of the rows
    chosen so far.  Of the rows left, the one comes next whose largest load over
    its even share is least; then the one that raises the squared deviations
    from the shares, each over its share (1 at least), by the least sum; then
    the one with the least hash and key.  A null is a value of its axis.

    Rows of equal axis values differ by hash alone, so k of each combination
    are enough; the driver gets k rows of each combination of axis values.
    """
    h = F.sha2(F.concat_ws("|", F.lit(domain), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*axes).orderBy("_h", key)
    few = pool.select(key, *axes, h.alias("_h")).withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    waiting: dict[tuple, list] = {}
    for r in few.orderBy(F.desc("_h"), F.desc(key)).collect():
        waiting.setdefault(tuple(r[a] for a in axes), []).append((r["_h"], r[key]))
    loads = [Counter() for _ in axes]
    values = [len({c[i] for c in waiting}) for i in range(len(axes))]
    out = []
    for step in range(k):
        if not waiting:
            break
        shares = [Fraction(step + 1, n) for n in values]

        def score(c: tuple) -> tuple:
            own = [m[v] for m, v in zip(loads, c, strict=True)]
            over = max((n + 1) / share for n, share in zip(own, shares, strict=True))
            return over, sum((2 * (n - share) + 1) / max(share, 1) for n, share in zip(own, shares, strict=True)), waiting[c][-1]

        best = min(waiting, key=score)
        out.append((waiting[best].pop()[1], step))
        for m, v in zip(loads, best, strict=True):
            m[v] += 1
        if not waiting[best]:
            del waiting[best]
    kind = dict(pool.dtypes)[key]
    chosen = pool.sparkSession.createDataFrame(out, f"_key {kind}, step long")
    return pool.select(key, *axes).join(F.broadcast(chosen), F.col(key) == F.col("_key")).drop("_key")


def blind_choice(metrics: DataFrame, base: str, names: list[str], min_folds: int, min_gains: int) -> DataFrame:
    """(candidate, folds_won, gains, rank_sum, eligible, chosen) from rows (candidate, fold, metric...), less is better.

    A candidate is eligible if it beats ``base`` on the mean of its metrics in
    enough folds and strictly on enough metrics overall.  Of the eligible, the
    least sum of ranks is chosen, ties by name; without one, ``base`` is.
    """
    mean = sum((F.col(m) for m in names[1:]), F.col(names[0])) / len(names)
    fold = metrics.select("candidate", "fold", mean.alias("_m"))
    won = fold.join(fold.filter(F.col("candidate") == base).select("fold", F.col("_m").alias("_b")), "fold").groupBy("candidate").agg(F.count_if(F.col("_m") < F.col("_b")).alias("folds_won"))
    total = metrics.groupBy("candidate").agg(*[F.avg(m).alias(m) for m in names])
    ref = total.filter(F.col("candidate") == base).select(*[F.col(m).alias(f"_{m}") for m in names])
    gains = sum((F.when(F.col(m) < F.col(f"_{m}"), 1).otherwise(0) for m in names), F.lit(0)).cast("long")
    # One row per candidate: the windows hold no more than the candidates.
    ranks = sum((F.row_number().over(Window.orderBy(F.col(m), F.col("candidate"))) for m in names), F.lit(0)).cast("long")
    one = total.crossJoin(ref).select("candidate", gains.alias("gains"), ranks.alias("rank_sum")).join(won, "candidate")
    one = one.withColumn("eligible", (F.col("candidate") != base) & (F.col("folds_won") >= min_folds) & (F.col("gains") >= min_gains))
    first = F.row_number().over(Window.orderBy(F.when(F.col("eligible"), 0).when(F.col("candidate") == base, 1).otherwise(2), F.when(F.col("eligible"), F.col("rank_sum")), "candidate")) == 1
    return one.withColumn("chosen", first).select("candidate", "folds_won", "gains", "rank_sum", "eligible", "chosen")
