"""Lineage-first cluster bootstrap over whole tables, by weights that every task draws for itself.

In a stratum (fold and family) with m lineages, a replicate draws m lineages with
replacement and, inside each one drawn, as many cases with replacement as it
has.  All statistics of it are sums over cases of the times that each was drawn.

Draws need no shuffle and no table of draws.  Lineages lie in blocks by hash.
The m draws are split over the blocks along a binary tree: a node hands the left
one of its children a binomial share by sizes, from a counter-based generator
(Philox) whose key is the digest of domain, stratum, node and replicates.  So
each task walks from the root to its own block and agrees with all others on
the counts above, and the draws of all blocks together are multinomial.  A
lineage with very many cases is split into parts along a tree of its own in the
same way.  A tile (parts of a block's cases, bounded in size) is one row; its
weights, replicates by cases, are multiplied with its values a few replicates at a
time, so that they stay in the processor's cache.  Tasks get tiles of one stratum
side by side: those of a block share its draws of lineages, and only sums over all
the tiles of a stratum that a task holds leave it.

Replicates whose weights repeat those of an earlier one are left out, and others
drawn for them; weights are compared by two 64-bit fingerprints, which mix four
exact sums of weights times 32-bit hashes of the cases in every tile.

Cases (fold, family, lineage, case_id, values): rows with a null key are left
out; a case is a row, so repeated rows are cases of their own.  A statistic with
a drawn case whose value is null, NaN or infinite is null.  An empty table gives
no rows; a table that has too few different replicates is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Lineages of a block and cases of a tile, about; both by hash.
BLOCK, TILE = 2048, 4096
#: Replicates that a tile draws at a time; draws depend on it.
TOGETHER = 250
#: Tasks that share the replicates of a tile, at most, where there are fewer tiles than tasks.
SHARES = 8
#: Replicates that are summed at a time, and tiles of a block that share its draws of lineages.
STEP, SIDE = 10, 16
#: Draws of a tile's replicate below which sums of 32-bit hashes are exact in doubles.
EXACT = 1 << 21
_KEY = ("fold", "family")


def stream(*name: object) -> np.random.Generator:
    """The generator of a name: the same wherever and whenever it is asked for."""
    key = hashlib.sha256("|".join(map(str, name)).encode()).digest()[:16]
    return np.random.Generator(np.random.Philox(key=np.frombuffer(key, np.uint64)))


def descend(counts: np.ndarray, sizes: Sequence[int], bucket: int, *name: object) -> np.ndarray:
    """How many of ``counts`` draws fall to a bucket: ``sizes`` are those of its nodes from the bucket to the root."""
    for level in range(len(sizes) - 1, 0, -1):
        whole, own = sizes[level], sizes[level - 1]
        right = bucket >> level - 1 & 1
        left = whole - own if right else own
        share = stream(*name, level, bucket >> level).binomial(counts, left / whole)
        counts = counts - share if right else share
    return counts


def _bits(n: float, most: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, n / most)))))


def _sizes(df: DataFrame, keys: list[str], bucket: str, size: str, depth: int) -> Column:
    """Sizes of a bucket's nodes from itself to the root."""
    return F.array(*[F.sum(size).over(Window.partitionBy(*keys, F.shiftright(bucket, level))) for level in range(depth + 1)])


def tiles(cases: DataFrame, values: Sequence[str], named: bool = False) -> DataFrame:
    """One row a tile: its stratum, block, sizes up to the root, and its cases (``named``: with their ids) with what their lineages' draws depend on."""
    own = cases.dropna(subset=[*_KEY, "lineage", "case_id"]).select(*[F.col(k).cast("string").alias(k) for k in _KEY], F.col("lineage").cast("string").alias("lineage"), F.col("case_id").cast("string").alias("case_id"), F.array(*[F.col(v).cast("double") for v in values]).cast("array<double>").alias("v"))
    lineages = own.groupBy(*_KEY, "lineage").agg(F.count(F.lit(1)).alias("n"))
    most = lineages.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).agg(F.max("m"), F.max("n")).first()
    depth, parted = _bits(most[0] or 0, BLOCK), _bits(most[1] or 0, TILE)
    lineages = lineages.withColumn("block", F.pmod(F.xxhash64("lineage"), F.lit(1 << depth)).cast("int"))
    blocks = lineages.groupBy(*_KEY, "block").agg(F.count(F.lit(1)).alias("size"), F.sum(F.when(F.col("n") <= TILE, F.col("n")).otherwise(0)).alias("small"))
    blocks = blocks.withColumn("sizes", _sizes(blocks, list(_KEY), "block", "size", depth))
    # A lineage of more cases than a tile has as many parts as a power of two gives.
    bits = F.when(F.col("n") > TILE, F.ceil(F.log2(F.col("n") / TILE))).otherwise(0).cast("int")
    placed = lineages.withColumn("place", F.row_number().over(Window.partitionBy(*_KEY, "block").orderBy("lineage")) - 1).withColumn("bits", bits)
    dealt = own.join(placed, [*_KEY, "lineage"]).withColumn("part", F.pmod(F.xxhash64("case_id", F.lit(1)), F.pow(F.lit(2.0), F.col("bits")).cast("long")).cast("int"))
    if parted:
        parts = dealt.filter("bits > 0").groupBy(*_KEY, "lineage", "part").agg(F.count(F.lit(1)).alias("own"))
        parts = parts.withColumn("nodes", _sizes(parts, [*_KEY, "lineage"], "part", "own", parted)).withColumn("lead", F.col("part") == F.min("part").over(Window.partitionBy(*_KEY, "lineage"))).drop("own")
        dealt = dealt.join(parts, [*_KEY, "lineage", "part"], "left").withColumn("nodes", F.when(F.col("bits") > 0, F.slice("nodes", 1, F.col("bits") + 1)).otherwise(F.array("n"))).withColumn("lead", F.coalesce("lead", F.lit(True)))
    else:
        dealt = dealt.withColumn("nodes", F.array("n")).withColumn("lead", F.lit(True))
    salt = F.pmod(F.xxhash64("lineage", F.lit(2)), F.ceil(F.col("small") / TILE))
    tile = F.when(F.col("bits") > 0, F.concat_ws("/", F.lit("part"), "part", "lineage")).otherwise(F.concat_ws("/", F.lit("tile"), salt))
    one = F.struct("place", "lineage", "case_id", F.xxhash64(*_KEY, "lineage", "case_id").alias("h0"), F.xxhash64("case_id", "lineage", *_KEY, F.lit(3)).alias("h1"), "n", "v")
    # A part is one of a single lineage; other tiles have lineages of one part, for which the number of nodes counts.
    firsts = [F.first(c).alias(c) for c in ("size", "sizes", "part", "lead", "nodes")]
    got = dealt.join(blocks, [*_KEY, "block"]).groupBy(*_KEY, "block", tile.alias("tile")).agg(*firsts, F.sort_array(F.collect_list(one)).alias("cases"))
    return got if named else got.withColumn("cases", F.transform("cases", lambda c: F.struct(*[c[k].alias(k) for k in ("place", "h0", "h1", "n", "v")])))


class Tile:
    """The cases of one tile, and the weights of any replicates."""

    def __init__(self, batch: pa.RecordBatch, i: int, domain: str):
        at = {k: batch.column(k)[i] for k in batch.schema.names}
        self.fold, self.family, self.block, self.tile = (at[k].as_py() for k in (*_KEY, "block", "tile"))
        self.domain, self.size, self.sizes = domain, at["size"].as_py(), at["sizes"].as_py()
        c = at["cases"].values
        place = c.field("place").to_numpy()
        first = np.flatnonzero(np.diff(place, prepend=-1))
        #: Per lineage of the tile: place in the block, cases here, all cases; of a part the sizes of its nodes.
        self.place, self.here = place[first], np.diff(np.append(first, len(place)))
        self.first, self.n = first, c.field("n").to_numpy()[first]
        self.part, self.lead, self.nodes = (at[k].as_py() for k in ("part", "lead", "nodes"))
        self.cases = c
        v = c.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.values = v.reshape(len(place), len(v) // len(place))

    def _name(self, group: int) -> tuple:
        return (self.domain, self.fold, self.family, group)

    def hits(self, group: int) -> np.ndarray:
        """Times that each lineage of the block was drawn, a row a replicate of the group; the same for all tiles of a block."""
        name = self._name(group)
        down = descend(np.full(TOGETHER, self.sizes[-1], np.int64), self.sizes, self.block, *name, "block")
        hit = stream(*name, "lineage", self.block).integers(0, self.size, int(down.sum()))
        hit += np.repeat(np.arange(TOGETHER) * self.size, down)
        return np.bincount(hit, minlength=TOGETHER * self.size).reshape(TOGETHER, self.size)

    def draws(self, group: int, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(times that lineages were drawn, cases drawn in each), a row a replicate of the group."""
        times = hits[:, self.place]
        if len(self.nodes) == 1:
            return times, times * self.n
        # Part of one large lineage.
        return times, descend(times[:, 0] * self.n[0], self.nodes, self.part, *self._name(group), "part", self.block, int(self.place[0]))[:, None]

    def weights(self, group: int, draws: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """(replicates, times that cases were drawn) of the group, ``STEP`` rows at a time."""
        unit, total, here = stream(*self._name(group), "case", self.block, self.tile), int(self.here.sum()), self.here.astype(np.float64)
        for start in range(0, TOGETHER, STEP):
            rows = slice(start, min(start + STEP, TOGETHER))
            many, k = rows.stop - start, draws[rows].ravel()
            # Numbers of the generator go to the draws in order, however many rows are taken together.
            pick = np.repeat(np.tile(here, many), k)
            pick *= unit.random(len(pick))
            cell = np.repeat((np.arange(many)[:, None] * total + self.first).ravel(), k)
            cell += pick.astype(np.int64)
            yield rows, np.bincount(cell, minlength=many * total).reshape(many, total)

    def pieces(self) -> np.ndarray:
        """Four 32-bit hashes of each case."""
        both = [self.cases.field(k).to_numpy().view(np.uint64) for k in ("h0", "h1")]
        return np.stack([x for h in both for x in (h >> np.uint64(32), h & np.uint64(0xFFFFFFFF))], axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def marks(sums: np.ndarray) -> np.ndarray:
    """Two 64-bit fingerprints a row of the four sums of hashes by weights."""
    return np.stack([_mixed(sums[:, i] + _mixed(sums[:, i + 1] + np.uint64(1))) for i in (0, 2)], axis=1)


def _shared(laid: DataFrame) -> tuple[DataFrame, int]:
    """Every tile once a share of the replicates, tiles of a stratum and share side by side, dealt evenly over all tasks; the number of shares."""
    spark = laid.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = max(1, min(SHARES, -(-4 * tasks // max(1, laid.count()))))
    by = [*_KEY, "share", "block", "tile"]
    return laid.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartitionByRange(tasks, *by).sortWithinPartitions(*by), shares


class _Sums:
    """Sums over tiles of one stratum, for the replicates of one group."""

    def __init__(self, columns: int):
        self.counts, self.marks, self.sums = np.zeros((4, TOGETHER), np.int64), np.zeros((TOGETHER, 2), np.uint64), np.zeros((TOGETHER, columns))

    def add(self, t: Tile, group: int, hits: np.ndarray, by: np.ndarray, pieces: np.ndarray, spoilt: np.ndarray) -> None:
        """``by``: values of each case, whether those of the ``spoilt`` columns are bad, and its pieces."""
        width, sound = by.shape[1] - 4, by.shape[1] - 4 - len(spoilt)
        at = np.append(np.arange(sound), len(self.sums[0]) - t.values.shape[1] + spoilt)
        got, hashed = np.empty((TOGETHER, by.shape[1])), np.empty((TOGETHER, 4), np.uint64)
        times, draws = t.draws(group, hits)
        for rows, drawn in t.weights(group, draws):
            np.matmul(drawn.astype(np.float64), by, out=got[rows])
            # Whole numbers, and so the same whether doubles or integers give them.
            hashed[rows] = got[rows, width:] if draws[rows].sum(1).max() < EXACT else drawn.astype(np.uint64) @ pieces
            self.counts[1, rows] += [np.count_nonzero(x) for x in drawn > 0]
        self.marks ^= marks(hashed)
        self.sums[:, at] += got[:, :width]
        self.counts[0] += draws.sum(1)
        # A lineage in parts is counted with the first of them.
        if t.lead:
            self.counts[2:] += np.count_nonzero(times, axis=1), (times * times).sum(1)


def _sums(domain: str, groups: range, shares: int, occurrence: np.ndarray, count: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles_ = ((Tile(b, i, domain), share) for b in batches for i, share in enumerate(b.column("share").to_pylist()))
        for (fold, family, mine), own in groupby(tiles_, lambda x: (x[0].fold, x[0].family, x[1])):
            mine_ = [g for g in groups if g % shares == mine]
            sums, m = None, 0
            for _, of in groupby((t for t, _ in own), lambda t: t.block):
                while side := list(islice(of, SIDE)):
                    m, with_ = side[0].sizes[-1], []
                    for t in side:
                        sound = np.isfinite(t.values)
                        values, bad = np.where(sound, t.values, 0.0), ~sound
                        share = values[:, occurrence] / np.repeat(t.n, t.here)[:, None]
                        # Columns without a bad value add nothing.
                        spoilt = np.flatnonzero(bad.any(0))
                        pieces = t.pieces()
                        with_.append((spoilt, np.concatenate([share, values[:, count], bad[:, spoilt].astype(np.float64), pieces.astype(np.float64)], axis=1), pieces))
                    sums = sums or {g: _Sums(len(occurrence) + len(count) + t.values.shape[1]) for g in mine_}
                    for g in mine_:
                        hits = side[0].hits(g)
                        for t, (spoilt, by, pieces) in zip(side, with_, strict=True):
                            sums[g].add(t, g, hits, by, pieces, spoilt)
            for g in mine_:
                s, head = sums[g], [pa.array([x] * TOGETHER) for x in (fold, family, m)]
                yield pa.record_batch([pa.array(g * TOGETHER + np.arange(TOGETHER)), *head, *map(pa.array, s.counts), *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in s.marks.T], *[pa.array(np.ascontiguousarray(x)) for x in s.sums.T]], names=names)

    return run


def _candidates(laid: DataFrame, groups: range, domain: str, values: Sequence[str], occurrence: Sequence[str], count: Sequence[str]) -> DataFrame:
    names = ["candidate", *_KEY, "m", "drawn", "cases", "lineages", "squares", "mark0", "mark1", *[f"occ_{v}" for v in occurrence], *[f"cnt_{v}" for v in count], *[f"bad_{v}" for v in values]]
    kinds = ["long", "string", "string", *["long"] * 7, *["double"] * (len(names) - 10)]
    at = [np.array([values.index(v) for v in of], np.int64) for of in (occurrence, count)]
    dealt, shares = _shared(laid)
    got = dealt.mapInArrow(_sums(domain, groups, shares, *at, names), ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    adds = [F.sum(c).alias(c) for c in names if c not in ("candidate", *_KEY, "m", "mark0", "mark1")]
    return got.groupBy("candidate", *_KEY).agg(F.max("m").alias("m"), *[F.bit_xor(c).alias(c) for c in ("mark0", "mark1")], *adds)


def resample(cases: DataFrame, replicates: int, domain: str, occurrence: Sequence[str] = (), count: Sequence[str] = ()) -> DataFrame:
    """(replicate, fold, family, m, drawn, cases, lineages, ess, occ_v..., cnt_v...) of every replicate and stratum.

    ``occ_v``: mean over drawn lineages of the mean of the cases drawn in each.
    ``cnt_v``: mean over cases, each as often as it was drawn.  ``ess``: Kish's
    effective number of lineages.  ``drawn``, ``cases`` and ``lineages`` count
    draws, different cases and different lineages.
    """
    values = list(dict.fromkeys([*occurrence, *count]))
    laid = written(tiles(cases, values), "tiles")
    done, total, found = None, 0, -1
    while True:
        upto = -(-max(replicates, 2 * total) // TOGETHER) if done is not None else -(-replicates // TOGETHER)
        more = written(_candidates(laid, range(total // TOGETHER, upto), domain, values, occurrence, count), "candidates")
        done, total = more if done is None else done.unionByName(more), upto * TOGETHER
        firsts = done.groupBy("candidate").agg(F.bit_xor("mark0").alias("a"), F.bit_xor("mark1").alias("b")).groupBy("a", "b").agg(F.min("candidate").alias("candidate"))
        before, found = found, firsts.count()
        if found >= replicates or not found:
            break
        if found == before:
            raise ValueError(f"only {found} different replicates among {total} candidates")
    # As many rows as replicates are asked for, whatever the table.
    kept = firsts.select((F.row_number().over(Window.orderBy("candidate")) - 1).cast("long").alias("replicate"), "candidate").filter(F.col("replicate") < replicates)
    sound = lambda v, c: F.when(F.col(f"bad_{v}") == 0, c)
    return done.join(F.broadcast(kept), "candidate").select(
        "replicate", *_KEY, "m", "drawn", "cases", "lineages", (F.col("m") * F.col("m") / F.col("squares")).alias("ess"),
        *[sound(v, F.col(f"occ_{v}") / F.col("m")).alias(f"occ_{v}") for v in occurrence], *[sound(v, F.col(f"cnt_{v}") / F.col("drawn")).alias(f"cnt_{v}") for v in count],
    )


def case_weights(cases: DataFrame, replicates: int, domain: str) -> DataFrame:
    """(candidate, fold, family, lineage, case_id, lineage_times, weight) of the cases drawn by the first candidates, repeats among them too."""
    groups = range(-(-replicates // TOGETHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = Tile(batch, i, domain)
                of = np.repeat(np.arange(len(t.place)), t.here)
                for g in groups:
                    times, draws = t.draws(g, t.hits(g))
                    for rows, drawn in t.weights(g, draws):
                        row, col = np.nonzero(drawn)
                        own = [pa.array([x] * len(row), pa.string()) for x in (t.fold, t.family)]
                        ids = [t.cases.field(k).take(pa.array(col)) for k in ("lineage", "case_id")]
                        yield pa.record_batch([pa.array(g * TOGETHER + rows.start + row), *own, *ids, pa.array(times[rows][row, of[col]]), pa.array(drawn[row, col])], names=["candidate", *_KEY, "lineage", "case_id", "lineage_times", "weight"])

    got = tiles(cases, [], named=True).mapInArrow(run, "candidate long, fold string, family string, lineage string, case_id string, lineage_times long, weight long")
    return got.filter(F.col("candidate") < replicates)
