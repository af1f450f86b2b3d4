"""Exact nearest-neighbour joins under a legality rule.

Legal: another case and another lineage, and seeds that differ unless one is 0.
Rows are dealt to the cell of their nearest pivot, cells are cut into blocks of
bounded size, and blocks of queries meet blocks of training rows; each meeting
keeps its best k, and the k best overall are ranked by (distance, case, row).  Two cells do not meet where the triangle inequality shows that no
query of the one can have one of its k nearest in the other: every query's kth
legal distance inside the nearest cells bounds the true one from above.  Cells of
training rows that lie together are met as one group, so queries and candidates
are shuffled once a group, not once a cell; this visits cells of a group that
could be left out.  A block fits a task whatever the number of rows, and no side
is broadcast.

Rows with a null in any field, and vectors with an entry that is null, NaN or
infinite, have no neighbours and are nobody's neighbour.  Empty tables give no
rows; a query with fewer than k legal rows gets those it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.scratch import written
from .quantiles import numbered

#: Rows of a block of queries, and of training rows where a bound is sought.
BLOCK = 2048
#: Training rows that a block of queries meets at once: queries and what they find are shuffled once for each such block.
WIDE = 65536
#: Queries that a meeting holds at a time, training rows that set their first limit and that they meet after that, and pairs measured exactly at a time.
STEP, FIRST, PIECE, MEASURED = 512, 1024, 2048, 1 << 14
#: Cells at most: their pivots, radii and pairs are held by the driver.
PIVOTS = 1024
DRAWN = 4
#: With no more cells than this, bounds cost as much as they save, and all cells meet.
FEW = 8
#: Cells of which one block each gives a query's bound: work in proportion to the queries.
NEAREST = 2
#: Tasks that share the queries of one block of training rows.
SALTS = 8
#: Tasks of a meeting at most, in shuffle partitions.
SPREAD = 4
_FIELDS = ("row_id", "case_id", "lineage", "seed", "x")


def _usable(rows: DataFrame) -> DataFrame:
    return rows.select(*_FIELDS).dropna(subset=list(_FIELDS[:4])).filter(vectors.whole(F.col("x")))


def _pivots(train: DataFrame) -> np.ndarray:
    """As many different rows as there are blocks, up to ``PIVOTS``: of ``DRAWN`` times as many, the first by a hash of the id, each the farthest from those before it."""
    want = min(PIVOTS, math.ceil(train.count() / BLOCK))
    got = train.select("x", "row_id").orderBy(F.xxhash64("row_id"), "row_id").limit(want * DRAWN).collect()
    x = np.array([r["x"] for r in got], dtype=np.float64)
    chosen, away = [], np.full(len(x), np.inf)
    while len(chosen) < min(want, len(x)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _celled(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                cell = ((pivots**2).sum(1) - 2 * x @ pivots.T).argmin(1)
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*b.schema.names, "cell", "away"])

    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kind}, cell int, away double")


def _extent(celled: DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, radius) of each cell."""
    size, radius = np.zeros(cells, np.int64), np.zeros(cells)
    for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    return size, radius


def _parts(size: np.ndarray, block: int) -> np.ndarray:
    return np.maximum(1, -(-size // block))


def _blocks(celled: DataFrame, size: np.ndarray, name: str, block: int) -> DataFrame:
    parts = F.element_at(F.array(*[F.lit(n) for n in _parts(size, block).tolist()]), F.col("cell") + 1)
    one = F.struct(*[F.col(c) for c in _FIELDS])
    return celled.groupBy(F.col("cell").alias(f"{name}_cell"), F.pmod(F.xxhash64("row_id"), parts).cast("long").alias(f"{name}_part")).agg(F.collect_list(one).alias(name))


def _columns(column: pa.Array, i: int) -> tuple[np.ndarray, ...]:
    got = column[i].values
    x = got.field("x")
    n = len(got)
    return (*(got.field(k).to_numpy(zero_copy_only=False) for k in _FIELDS[:4]), x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64))


def cell_pairs(pivots: np.ndarray, q_radius: np.ndarray, bound: np.ndarray, t_size: np.ndarray, t_radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (cell of queries, cell of training rows) that may hold a neighbour.

    ``bound``: largest kth distance of a cell's queries, -1 where it has none.  A
    row of the second cell is no nearer to a query of the first than the pivots'
    distance less both radii; equality, and what rounding could hide, is kept.
    """
    sq = (pivots**2).sum(1)
    between = np.sqrt(np.maximum(sq[:, None] + sq - 2 * pivots @ pivots.T, 0))
    slack = 1e-6 * (1 + np.sqrt(sq.max()) + q_radius.max() + t_radius.max())
    least = between - q_radius[:, None] - t_radius
    return np.nonzero((bound[:, None] >= 0) & (t_size > 0) & (least <= bound[:, None] + slack))


def _grouped(pivots: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The group of each cell: that of the nearest of the first pivots, which lie far apart, one for each ``WIDE`` rows."""
    coarse = pivots[: max(1, -(-int(size.sum()) // WIDE))]
    return ((coarse**2).sum(1) - 2 * pivots @ coarse.T).argmin(1)


def _met(q: DataFrame, t: DataFrame, pairs: tuple[np.ndarray, np.ndarray], t_size: np.ndarray, block: int) -> DataFrame:
    """(q, t, q_cell) of all blocks of the paired cells; a block of t is sent ``SALTS`` times, one of q once a meeting."""
    spark = q.sparkSession
    keys = ["t_cell", "t_part", "salt"]
    # At most PIVOTS ** 2 rows of three numbers.
    names = pa.table({"q_cell": pa.array(pairs[0], pa.int32()), "t_cell": pa.array(pairs[1], pa.int32()), "parts": pa.array(_parts(t_size, block)[pairs[1]], pa.int64())})
    sent = q.join(F.broadcast(spark.createDataFrame(names)), "q_cell").withColumn("t_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    sent = sent.withColumn("salt", F.pmod(F.xxhash64("q_cell", "q_part"), F.lit(SALTS)))
    # A block and salt is a unit of work: as many tasks as there are, within reason, so that none gets several by chance while others get none.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(tasks, min(SPREAD * tasks, 2 * SALTS * int(_parts(t_size, block)[t_size > 0].sum())))
    kept = t.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # Blocks are many times what Spark takes their size for, that of the rows before they are sent to all salts; neither side is to be broadcast.
    return sent.repartition(tasks, *keys).hint("merge").join(kept.hint("merge"), keys).select("q", "t", "q_cell")


def _ordered(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Rows by case and id, so that of equal distances the earlier place comes first."""
    at = np.lexsort((rows[0], rows[1]))
    return tuple(x[at] for x in rows)


def _legal(q: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...]) -> np.ndarray:
    (_, q_case, q_lin, q_seed), (_, t_case, t_lin, t_seed) = q, t
    return (q_case != t_case) & (q_lin != t_lin) & ((q_seed == 0) | (q_seed != t_seed))


def _apart(q: np.ndarray, t: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for s in range(0, len(r), MEASURED):
        part = slice(s, s + MEASURED)
        out[part] = np.sqrt(((q[r[part]] - t[c[part]]) ** 2).sum(1))
    return out


def _sifted(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, own, slack): a @ b is, within ``slack`` of each query, the squared distance less ``own``.

    In single precision where no square leaves its range.  ``slack`` bounds what
    rounding can add up to: that of the entries, of the products and sums, and of
    taking the training rows' mean off both sides.
    """
    far = np.sqrt(max((q**2).sum(1).max(), (t**2).sum(1).max()))
    mean = t.mean(0)
    q, t = q - mean, t - mean
    own, squares = (q**2).sum(1), (t**2).sum(1)
    reach = (np.sqrt(own) + np.sqrt(squares.max())) ** 2
    kind = np.float32 if 1e-20 < reach.min() and reach.max() < 1e30 else np.float64
    slack = (q.shape[1] + 16) * np.finfo(kind).eps * reach + 32 * np.finfo(np.float64).eps * far * far
    a = np.hstack([-2 * q, np.ones((len(q), 1))]).astype(kind)
    return a, np.ascontiguousarray(np.hstack([t, squares[:, None]]).astype(kind).T), own, slack


def _nearest(k: int, q: tuple[np.ndarray, ...], t: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of t, distance) of the k nearest legal rows of t for each row of q; of equal distances, the earlier row of t.

    Pieces of t pass a sieve: what it cannot rule out, by each query's kth distance
    so far, is judged and measured exactly.
    """
    rows, places, apart = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if not len(q[0]):
        return rows[0], places[0], apart[0]
    a, b, own, slack = _sifted(q[4], t[4])
    for s in range(0, len(a), STEP):
        mine = tuple(x[s : s + STEP] for x in q)
        n = len(mine[0])
        # Not a number where there is no kth yet: it sorts after every distance, infinite ones too.
        best, at = np.full((n, k), np.nan), np.full((n, k), -1, np.int64)
        first = 0
        while first < len(t[0]):
            upto = first + (PIECE if first else FIRST)
            near = a[s : s + STEP] @ b[:, first:upto]
            edge = best[:, -1]
            limit = edge * edge * (1 + 1e-12) + slack[s : s + STEP] - own[s : s + STEP]
            legal, open_ = None, np.flatnonzero(np.isnan(edge))
            if len(open_):
                # Queries without k rows so far: legal rows alone set their limit.
                legal = _legal(tuple(x[open_, None] for x in mine[:4]), tuple(x[first:upto] for x in t[:4]))
                some = np.where(legal, near[open_], np.inf)
                limit[open_] = np.partition(some, k - 1, 1)[:, k - 1] + 2 * slack[s : s + STEP][open_] if some.shape[1] >= k else np.inf
            # One step up, as rounding the limit may have lowered it; what is not a number is kept.
            kept = ~(near > np.nextafter(limit.astype(near.dtype), near.dtype.type(np.inf))[:, None])
            if legal is not None:
                kept[open_] &= legal
            r, c = np.divmod(np.flatnonzero(kept), near.shape[1])
            c += first
            first = upto
            sound = _legal(tuple(x[r] for x in mine[:4]), tuple(x[c] for x in t[:4]))
            r, c = r[sound], c[sound]
            d = _apart(mine[4], t[4], r, c)
            # A later row of t has to be nearer than the kth.
            nearer = ~(d >= best[r, -1])
            r, c, d = r[nearer], c[nearer], d[nearer]
            if not len(r):
                continue
            has, start, of, count = np.unique(r, return_index=True, return_inverse=True, return_counts=True)
            new, new_at = np.full((len(has), count.max()), np.nan), np.full((len(has), count.max()), -1, np.int64)
            column = np.arange(len(r)) - start[of]
            new[of, column], new_at[of, column] = d, c
            new, new_at = np.hstack([best[has], new]), np.hstack([at[has], new_at])
            order = np.argsort(new, 1, kind="stable")[:, :k]
            best[has], at[has] = np.take_along_axis(new, order, 1), np.take_along_axis(new_at, order, 1)
        r, i = np.nonzero(at >= 0)
        rows.append(r + s)
        places.append(at[r, i])
        apart.append(best[r, i])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(apart)


def _meet(k: int, whole: bool, by_lineage: bool = False):
    """Per query and block the k nearest, or their distances alone (infinite where legal rows run out); with ``by_lineage`` the k nearest of each training lineage.

    Ranks are by distance, case and row, so no more than k of a block can be among the k of all.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, every = _columns(b.column(0), i), _ordered(_columns(b.column(1), i))
                own = [np.flatnonzero(every[2] == x) for x in np.unique(every[2])] if by_lineage else [slice(None)]
                out: list[tuple] = []
                for of in own:
                    t = tuple(x[of] for x in every)
                    # A query has no neighbours in its own lineage, and no bound from it.
                    mine = tuple(x[q[2] != t[2][0]] for x in q) if by_lineage else q
                    r, c, d = _nearest(k, mine, t)
                    if whole:
                        out.append((mine[0][r], t[0][c], t[1][c], t[2][c], d))
                        continue
                    near = np.full((len(mine[0]), k), np.inf)
                    near[r, np.arange(len(r)) - np.searchsorted(r, r)] = d
                    out.append((mine[0], np.full(len(mine[0]), t[2][0]), near))
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                if whole:
                    yield pa.record_batch([pa.array(x) for x in cols], names=["query", "neighbour", "case_id", "lineage", "distance"])
                else:
                    at = pa.array(np.arange(len(cols[0]) + 1, dtype=np.int32) * k)
                    yield pa.record_batch([pa.array(np.full(len(cols[0]), b.column(2)[i].as_py(), np.int32)), pa.array(cols[0]), pa.array(cols[1]), pa.ListArray.from_arrays(at, pa.array(cols[2].ravel()))], names=["q_cell", "query", "lineage", "near"])

    return meet


def _bounds(q: DataFrame, t: DataFrame, k: int, pivots: np.ndarray, q_size: np.ndarray, t_size: np.ndarray, by_lineage: bool, same: bool) -> np.ndarray:
    """Per cell the largest of its queries' kth distances inside blocks of the nearest filled cells; -1 for cells without queries."""
    filled = np.nonzero(t_size)[0]
    sq = (pivots**2).sum(1)
    near = np.argsort(sq[filled] - 2 * pivots @ pivots[filled].T, axis=1, kind="stable")[:, :NEAREST]
    own = np.nonzero(q_size)[0]
    pairs = np.repeat(own, near.shape[1]), filled[near[own]].ravel()
    # One block of a cell is enough for a bound, however many rows the cell has.
    met = _met(q, t.filter("t_part = 0"), pairs, np.minimum(t_size, BLOCK), BLOCK)
    near = met.mapInArrow(_meet(k, False, by_lineage), "q_cell int, query long, lineage long, near array<double>")
    kth = near.groupBy("q_cell", "query", *(["lineage"] if by_lineage else [])).agg(F.array_sort(F.flatten(F.collect_list("near")))[k - 1].alias("kth"))
    out = np.where(q_size > 0, np.inf, -1.0)
    if by_lineage:
        # A query that has not met all lineages but its own near by has no bound.
        lineages = -int(same) + t.select(F.explode("t.lineage").alias("lineage")).distinct().count()
        full = kth.groupBy("q_cell", "query").agg(F.max("kth").alias("most"), F.count(F.lit(1)).alias("met"))
        kth = full.select("q_cell", F.when(F.col("met") >= lineages, F.col("most")).otherwise(float("inf")).alias("kth"))
    for r in kth.groupBy("q_cell").agg(F.max("kth").alias("most")).collect():
        out[r["q_cell"]] = r["most"]
    return out


def legal_neighbours(queries: DataFrame, train: DataFrame, k: int, by_lineage: bool = False) -> DataFrame:
    """(query, rank, neighbour, distance) of both sides (row_id, case_id, lineage, seed, x array<double>).

    With ``by_lineage`` the k nearest in each training lineage, from which those
    of any set of lineages can be merged, with two more columns (lineage, case_id).
    """
    same = queries is train
    queries, train = _usable(queries), _usable(train)
    pivots = _pivots(train)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], "query long, rank long, neighbour long, distance double" + (", lineage long, case_id long" if by_lineage else ""))
    t_rows = _celled(train, pivots)
    q_rows = t_rows if same else _celled(queries, pivots)
    t_size, t_radius = _extent(t_rows, len(pivots))
    q_size, q_radius = (t_size, t_radius) if same else _extent(q_rows, len(pivots))
    q = _blocks(q_rows, q_size, "q", BLOCK)
    bound = np.where(q_size > 0, np.inf, -1.0)
    if len(pivots) > FEW:
        bound = _bounds(q, _blocks(t_rows, t_size, "t", BLOCK), k, pivots, q_size, t_size, by_lineage, same)
    group = _grouped(pivots, t_size)
    of_cell, cell = cell_pairs(pivots, q_radius, bound, t_size, t_radius)
    pairs = np.unique(np.stack([of_cell, group[cell]]), axis=1)
    wide_size = np.bincount(group, t_size, len(pivots)).astype(np.int64)
    wide = t_rows.withColumn("cell", F.element_at(F.array(*[F.lit(g) for g in group.tolist()]), F.col("cell") + 1))
    found = _met(q, _blocks(wide, wide_size, "t", WIDE), (pairs[0], pairs[1]), wide_size, WIDE).select("q", "t").mapInArrow(_meet(k, True, by_lineage), "query long, neighbour long, case_id long, lineage long, distance double")
    order = Window.partitionBy("query", *(["lineage"] if by_lineage else [])).orderBy("distance", "case_id", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", F.col("rank").cast("long").alias("rank"), "neighbour", "distance", *(["lineage", "case_id"] if by_lineage else []))


#: Candidates that a query draws first; every round draws twice as many.
DRAWS = 32


def _candidates(queries: DataFrame, train: DataFrame, n: int, first: int, upto: int, domain: str) -> DataFrame:
    """(query, i, comparator) of the legal ones among candidates ``first`` to ``upto`` of each query, a number of a training row each."""
    drawn = queries.withColumn("i", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(upto - 1).cast("long"))))
    text = F.concat_ws("|", F.lit(domain), F.col("query").cast("string"), F.col("i").cast("string"))
    drawn = drawn.withColumn("number", F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") % F.lit(n))
    legal = (F.col("qc") != F.col("case_id")) & (F.col("ql") != F.col("lineage")) & ((F.col("qs") == 0) | (F.col("qs") != F.col("seed")))
    # Candidates are many times what Spark takes their size for, that of the queries before they are drawn; neither side is to be broadcast.
    return drawn.hint("merge").join(train.hint("merge"), "number").filter(legal).select("query", "i", F.col("row_id").alias("comparator"))


def _pools(queries: DataFrame, train: DataFrame) -> DataFrame:
    """(query, pool): how many training rows are legal, from counts of rows alike in case, lineage and seed."""
    own = {"case_id": "qc", "lineage": "ql", "seed": "qs"}
    out, barred = queries, F.lit(0)
    for i, names in enumerate((("case_id",), ("lineage",), ("seed",), ("case_id", "lineage"), ("case_id", "seed"), ("lineage", "seed"), tuple(own))):
        counts = train.groupBy(*[F.col(k).alias(own[k]) for k in names]).agg(F.count(F.lit(1)).alias(f"_n{i}"))
        out = out.join(counts, [own[k] for k in names], "left")
        alike = F.coalesce(F.col(f"_n{i}"), F.lit(0)) * (1 if len(names) != 2 else -1)
        barred = barred + (F.when(F.col("qs") != 0, alike).otherwise(0) if "seed" in names else alike)
    return out.select("query", (F.lit(train.count()) - barred).alias("pool"))


def _drawn(queries: DataFrame, train: DataFrame, n: int, k: int, domain: str, taken: DataFrame | None = None) -> DataFrame:
    """(query, rank, comparator): the first k different legal candidates of each query that are not in ``taken``, or its whole pool."""
    found, open_, first, upto = None, queries, 0, DRAWS
    while True:
        got = _candidates(open_, train, n, first, upto, domain)
        if taken is not None:
            got = got.join(taken.select("query", "comparator").hint("merge"), ["query", "comparator"], "left_anti")
        got = written(got.groupBy("query", "comparator").agg(F.min("i").alias("i")), "drawn")
        found = got if found is None else found.unionByName(got).groupBy("query", "comparator").agg(F.min("i").alias("i"))
        # A query goes on until it has k or its whole pool; the pools are counted for those few that need more than one round.
        have = found.groupBy("query").agg(F.count(F.lit(1)).alias("have"))
        short = written(open_.join(have, "query", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < k).drop("have"), "open")
        if first:
            pools = _pools(short, train)
            if taken is not None:
                used = taken.groupBy("query").agg(F.count(F.lit(1)).alias("used"))
                pools = pools.join(used, "query", "left").select("query", (F.col("pool") - F.coalesce("used", F.lit(0))).alias("pool"))
            left = short.join(pools, "query").join(have, "query", "left").filter(F.coalesce("have", F.lit(0)) < F.col("pool"))
            short = written(left.select(*short.columns), "open")
        open_ = short
        if not open_.limit(1).count():
            break
        first, upto = upto, upto + 2 * (upto - first)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("i"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query", "rank", "comparator")


def matched_random(queries: DataFrame, train: DataFrame, k: int, domain: str, extension: int = 0) -> DataFrame:
    """(query, rank, comparator): k legal training rows of each query, without replacement; the same for every arm.

    Training rows are numbered in order of ``row_id``.  Candidate i of a query is the
    row whose number is the SHA-256 of domain, query and i modulo their count; the
    first k that are legal and different are kept, so the work follows queries and
    k, whatever the number of training rows.  ``extension`` more, with a domain of
    their own, come from what is left and do not change the first.  A query with
    fewer legal rows gets them all.  Rows with a null key take no part, and empty
    tables give no rows.
    """
    keys = ["row_id", "case_id", "lineage", "seed"]
    rows = numbered(train.select(*keys).dropna(), ["row_id"], "number")
    own = written(queries.select(*keys).dropna().select(F.col("row_id").alias("query"), F.col("case_id").alias("qc"), F.col("lineage").alias("ql"), F.col("seed").alias("qs")), "queries")
    n = rows.count()
    if not n:
        return own.limit(0).select("query", F.lit(0).cast("long").alias("rank"), F.col("query").alias("comparator"))
    first = _drawn(own, rows, n, k, domain)
    if not extension:
        return first
    first = written(first, "first")
    more = _drawn(own, rows, n, extension, f"{domain}-extension", first)
    return first.unionByName(more.withColumn("rank", F.col("rank") + k))
