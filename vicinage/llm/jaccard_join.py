"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A document's set holds its distinct shingles of ``SHINGLE`` words.  Two documents
link when 100 |A and B| >= ``PERCENT`` |A or B|.  Equal sets are one node from the
start.  A set's tokens are ordered by hash, and its prefix is so long that linked
sets share at least ``k`` tokens of theirs, k growing with the size:

1. A set can have a link only if enough of its prefix occurs in the prefixes of
   other sets of like size; the rest is settled by this count alone.
2. What is left meets in tiles, one per prefix token, sorted by size: only sets
   of one size band can link.  First each set is tried with the tile member that
   most of its tiles begin with, and what links is joined to components.
3. Then all pairs of different components in a band are bounded by their hashed
   bitmaps: every bit that one has and the other lacks is an element outside the
   intersection.  Components that any pair's bound connects form a cluster.
4. Each cluster's sets are sent once to where all its pairs, those inside a
   component too, are bounded again by larger bitmaps and then intersected exactly.
   A large cluster is cut into blocks, and each two of them, and each one with
   itself, are one such place, which hands on each set's count of links.

No pair is lost: a component of several sets is a cluster or a part of one, and
each pair of a cluster that fits in size is tested in one place.

Nulls and texts without words: an empty set, linked with nothing.  A null id
comes after all others.  Rows that repeat an id are told apart by their text.
Empty tables give empty results.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, blocks, groups, mix, ranges, span_hash, words
from .graph import components
from .store import materialize, parts

SHINGLE = 4
PERCENT = 85
#: Share of a set's size by which its prefix and the number of shared tokens grow.
EXTRA = 0.1
#: Rounds of trying leaders before all remaining pairs are bounded.
LEADER_ROUNDS = 1
#: Bits of a bitmap in a tile: the size's next power of two, within these; and in a cluster.
BITS = (64, 4096)
CLUSTER_BITS = 8192
#: Sets of a cluster that one task gets from each of two blocks.
BLOCK = 2048
#: Text bytes whose prefix tokens a task merges before it sends them on, and whose sets it prepares for tiles.
SEND_BYTES, TILE_BYTES = 8 << 20, 2 << 20
#: Members of a tile that are compared at a time.
TILE = 1024
_LAST = (1 << 63) - 1
_SEED = 31


def shingles(buf: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(values, n+1 offsets): each document's distinct shingles as sorted 64-bit hashes; a shorter text is one shingle."""
    low = LOWER[buf]
    s, e, doc = words(low, at)
    n = len(at) - 1
    word = span_hash(low, s, e, _SEED)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    take = np.where(count >= width, count - width + 1, 0)
    i = ranges(first, take)
    value = np.full(len(i), width, np.uint64)
    for j in range(width):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + word[i + j])
    owner = np.repeat(np.arange(n), take)
    for d in np.flatnonzero((count > 0) & (count < width)).tolist():
        v = np.full(1, count[d], np.uint64)
        for w in word[first[d] : first[d] + count[d]]:
            v = mix(v * np.uint64(0x9E3779B97F4A7C15) + w)
        value, owner = np.append(value, v), np.append(owner, d)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(n + 1))


def set_keys(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit identifiers of each set (empty sets: 0), from sums over its elements."""
    a, b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value))]), np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(~value))])
    return mix(a[at[1:]] - a[at[:-1]]).view(np.int64), mix(b[at[1:]] - b[at[:-1]]).view(np.int64)


def least_overlap(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The smallest intersection of a set of size n with any set that it links to."""
    return -(-percent * n // 100)


def shared_least(n: np.ndarray) -> np.ndarray:
    """Prefix tokens that a set of size n shares at least with a linked set of no smaller size."""
    return 1 + (EXTRA * n).astype(np.int64)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return np.minimum(n, n - least_overlap(n, percent) + shared_least(n))


def _prefixes(value: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)
    p = np.where(n > 0, prefix_length(n, percent), 0)
    return value[ranges(at[:-1], p)], np.repeat(np.arange(len(n)), p)


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, at in blocks(batches, "text"):
            value, first = shingles(buf, at, width)
            k1, k2 = set_keys(value, first)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(k1), pa.array(k2), pa.array(np.diff(first))], names=["id", "own_id", "th", "k1", "k2", "n"])

    return docs.mapInArrow(run, "id long, own_id long, th long, k1 long, k2 long, n long")


_TOKEN = np.dtype([("token", "<u8"), ("key", "<i8"), ("n", "<u4")])
_COUNT = np.dtype([("key", "<i8"), ("n", "<u4"), ("shared", "<u4")])


def _by_part(token: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts tokens by part, the parts there are and where each begins."""
    part = (token % np.uint64(count)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    at, _ = groups(part[order])
    return order, part[order][at], at


def _distinct(r: np.ndarray) -> np.ndarray:
    """Records without repeats, by token, size and key."""
    r = r[np.lexsort((r["key"], r["n"], r["token"]))]
    return r[np.append(True, (r["token"][1:] != r["token"][:-1]) | (r["key"][1:] != r["key"][:-1]))[: len(r)]]


def _parcels(r: np.ndarray, by: np.ndarray, count: int) -> pa.RecordBatch:
    """Records as one binary value for each part that their ``by`` falls in."""
    order, part, at = _by_part(by, count)
    return pa.record_batch([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in np.split(r[order], at[1:])] if len(r) else [], pa.binary())], names=["part", "data"])


def _opened(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    held = [np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(1)]
    return np.concatenate(held) if held else np.zeros(0, kind)


def _maybe_linked(docs: DataFrame, percent: int, width: int, count: int) -> DataFrame:
    """Keys of the sets of whose prefix enough tokens occur in the prefix of another set of fitting size."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        r = np.zeros(sum(len(x[0]) for x in held), _TOKEN)
        r["token"], r["key"], r["n"] = (np.concatenate([x[k] for x in held]) for k in range(3))
        r = _distinct(r)
        return _parcels(r, r["token"], count)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for _, buf, at in blocks(batches, "text"):
            value, first = shingles(buf, at, width)
            t, doc = _prefixes(value, first, percent)
            held.append((t, set_keys(value, first)[0][doc], np.diff(first)[doc]))
            size += len(buf)
            if size >= SEND_BYTES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _distinct(_opened(batches, _TOKEN))
        if not len(r):
            return
        # In order of size, a token's nearest neighbours tell whether any set fits.
        n = r["n"].astype(np.int64)
        fits = (r["token"][1:] == r["token"][:-1]) & (100 * n[:-1] >= percent * n[1:])
        near = np.append(fits, False) | np.append(False, fits)
        key, first, shared = np.unique(r["key"][near], return_index=True, return_counts=True)
        out = np.zeros(len(key), _COUNT)
        out["key"], out["n"], out["shared"] = key, r["n"][near][first], shared
        yield _parcels(out, mix(key.view(np.uint64)), count)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _opened(batches, _COUNT)
        r = r[np.argsort(r["key"], kind="stable")]
        at, _ = groups(r["key"])
        if not len(at):
            return
        # A linked set can be as small as ``percent`` of this one, and then shares fewer tokens.
        least = shared_least(least_overlap(r["n"][at].astype(np.int64), percent))
        yield pa.record_batch([pa.array(r["key"][at][np.add.reduceat(r["shared"].astype(np.int64), at) >= least])], names=["key"])

    parcel = "part int, data binary"
    sent = docs.mapInArrow(send, parcel).repartition(count, "part").mapInArrow(meet, parcel)
    return sent.repartition(count, "part").mapInArrow(total, "key long")


def bitmap_bits(n: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), *BITS)


def bitmap(value: np.ndarray, bits: int) -> np.ndarray:
    """Words of the bitmap in which the bit of each hash is set; half the bits are the halves' union."""
    out = np.zeros(bits, np.uint8)
    out[(value & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


_MEMBER = np.dtype([("key", "<i8"), ("comp", "<i8"), ("n", "<u4")])


def _tiles(sets: DataFrame, percent: int, width: int, count: int, leaders: bool) -> DataFrame:
    """Candidate pairs of different components, from tiles of (key, comp, text) rows.

    With ``leaders``, each set (b) with the firsts of its tiles (a) and the tokens
    ``shared``; else pairs of components (a, b) that connect all those of which any
    pair of sets in a size band is allowed by its bitmaps and shared tokens.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, at in blocks(batches, "text", TILE_BYTES):
            value, first = shingles(buf, at, width)
            member = np.zeros(b.num_rows, _MEMBER)
            member["key"], member["comp"], member["n"] = b.column(0).to_numpy(), b.column(1).to_numpy(), np.diff(first)
            bits = bitmap_bits(np.diff(first))
            maps = [bitmap(value[first[i] : first[i + 1]], int(bits[i])) if not leaders else np.zeros(0, np.uint64) for i in range(b.num_rows)]
            token, doc = _prefixes(value, first, percent)
            order, part, start = _by_part(token, count)
            token, doc = token[order], doc[order]
            data = []
            for i, j in zip(start.tolist(), np.append(start[1:], len(token)).tolist(), strict=True):
                own, which = np.unique(doc[i:j], return_inverse=True)
                data.append((token[i:j].tobytes(), which.astype(np.uint32).tobytes(), member[own].tobytes(), b"".join(maps[k].tobytes() for k in own.tolist())))
            c = list(zip(*data, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(part.astype(np.int32)), *[pa.array(x, pa.binary()) for x in c]], names=["part", "token", "which", "member", "maps"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, which, member, maps, base = [], [], [], [], 0
        for b in batches:
            for i in range(b.num_rows):
                own = np.frombuffer(b.column(3)[i].as_buffer(), _MEMBER)
                token.append(np.frombuffer(b.column(1)[i].as_buffer(), np.uint64))
                which.append(np.frombuffer(b.column(2)[i].as_buffer(), np.uint32).astype(np.int64) + base)
                member.append(own)
                base += len(own)
                if not leaders:
                    words_ = np.frombuffer(b.column(4)[i].as_buffer(), np.uint64)
                    maps.extend(np.split(words_, np.cumsum(bitmap_bits(own["n"].astype(np.int64)) // 64)[:-1]))
        if not token:
            return
        token, which, member = np.concatenate(token), np.concatenate(which), np.concatenate(member)
        order = np.lexsort((member["key"][which], member["n"][which], token))
        token, which = token[order], which[order]
        left, right = (_led if leaders else _bounded)(token, which, member, maps, percent)
        pair, shared = np.unique(np.stack([left, right], 1), axis=0, return_counts=True) if len(left) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        if not leaders:
            # Of the tokens that a pair has to share, one of the parts holds its share of them at least.
            need = shared_least(np.minimum(member["n"][pair[:, 0]], member["n"][pair[:, 1]]).astype(np.int64))
            pair = pair[shared * count >= need]
            tree = _forest(member["comp"][pair[:, 0]], member["comp"][pair[:, 1]])
            yield pa.record_batch([pa.array(tree[:, 0]), pa.array(tree[:, 1])], names=["a", "b"])
            return
        yield pa.record_batch([pa.array(member["key"][pair[:, 0]]), pa.array(member["key"][pair[:, 1]]), pa.array(shared)], names=["a", "b", "shared"])

    sent = sets.select("key", "comp", "text").mapInArrow(send, "part int, token binary, which binary, member binary, maps binary").repartition(count, "part")
    if not leaders:
        return sent.mapInArrow(meet, "a long, b long").distinct()
    return sent.mapInArrow(meet, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges that connect what all edges (a, b) connect, one less than the nodes of each component."""
    node, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = which[: len(a)], which[len(a) :]
    label = np.arange(len(node))
    out = [np.zeros((0, 2), np.int64)]
    while True:
        x, y = label[left], label[right]
        open_ = x != y
        if not open_.any():
            return np.concatenate(out)
        left, right, x, y = left[open_], right[open_], x[open_], y[open_]
        low, high = np.minimum(x, y), np.maximum(x, y)
        # Each larger label takes the least label next to it.
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        parent = np.arange(len(node))
        parent[high[first]] = low[first]
        out.append(np.stack([node[high[first]], node[low[first]]], 1))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def _led(token: np.ndarray, which: np.ndarray, member: np.ndarray, maps: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member with the first of its tile, or of its size band in the tile, if their components differ."""
    n = member["n"][which].astype(np.int64)
    band = np.floor(np.log(np.maximum(n, 1)) / -np.log(percent / 100)).astype(np.int64)
    lead = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (band[1:] != band[:-1]))[: len(token)])
    tile = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    out = []
    for starts in (lead, tile):
        first = starts[np.searchsorted(starts, np.arange(len(token)), "right") - 1]
        good = (member["comp"][which[first]] != member["comp"][which]) & (100 * n[first] >= percent * n)
        out.append((which[first[good]], which[good]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _bounded(token: np.ndarray, which: np.ndarray, member: np.ndarray, maps: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a tile that differ in component, fit in size, and whose bitmaps allow the overlap."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, count = groups(token)
    comp = member["comp"][which]
    mixed = np.maximum.reduceat(comp, at) != np.minimum.reduceat(comp, at) if len(at) else np.zeros(0, bool)
    for start, m in zip(at[mixed].tolist(), count[mixed].tolist(), strict=True):
        own = which[start : start + m]
        n = member["n"][own].astype(np.int64)
        c = member["comp"][own]
        reach = np.searchsorted(n, 100 * n // percent, "right")
        for i in range(m):
            for lo in range(i + 1, int(reach[i]), TILE):
                j = np.arange(lo, min(int(reach[i]), lo + TILE))
                j = j[c[j] != c[i]]
                if not len(j):
                    continue
                need = -(-percent * (n[i] + n[j]) // (100 + percent))
                a = maps[own[i]]
                # The bitmaps of larger sets can have twice the bits; their halves' union has as many.
                b = np.stack([x if len(x) == len(a) else x.reshape(-1, len(a))[0] | x.reshape(-1, len(a))[1] for x in (maps[k] for k in own[j])])
                most = np.minimum(n[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n[j] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
                j = j[most >= need]
                left.append(np.full(len(j), own[i])), right.append(own[j])
    return np.concatenate(left), np.concatenate(right)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs that link, by exact intersection of sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, buf, at in blocks(iter([whole]), "ta"):
                value, first = shingles(buf, at, width)
                (_, buf2, at2), = blocks(iter([b]), "tb", 1 << 62)
                value2, first2 = shingles(buf2, at2, width)
                good = []
                for i in range(b.num_rows):
                    x, y = value[first[i] : first[i + 1]], value2[first2[i] : first2[i + 1]]
                    at_y = np.searchsorted(y, x)
                    both = int((y[np.minimum(at_y, len(y) - 1)] == x).sum()) if len(y) else 0
                    good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    texts = sets.select("key", "text")
    # Texts are never broadcast, and the plan is the same at every size.
    with_a = pairs.select("a", "b").hint("merge").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.hint("merge").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _counted(held: list[tuple], own: bool, percent: int) -> list[tuple[int, int, int]]:
    """(key, joined key, links) of the sets that link in one place, from (key, comp, block, values).

    Every pair is tested, those inside a component too: with ``own`` the pairs of
    one block, else those of two blocks, so that each pair is counted in one place.
    """
    held.sort(key=lambda x: (len(x[3]), x[0]))
    key = np.array([x[0] for x in held])
    block = np.array([x[2] for x in held])
    n = np.array([len(x[3]) for x in held])
    maps = np.stack([bitmap(x[3], CLUSTER_BITS) for x in held])
    # Elements as small numbers, without those that a single set has.
    _, element, sets = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True, return_counts=True)
    shared = sets[element] > 1
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(shared)])[np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])]
    element = element[shared]
    marked = np.zeros(len(sets), np.int32)
    _, label = np.unique(np.array([x[1] for x in held]), return_inverse=True)
    links = np.zeros(len(held), np.int64)
    reach = np.searchsorted(n, 100 * n // percent, "right")
    for i in range(len(held)):
        mine = element[at[i] : at[i + 1]]
        marked[mine] = 1
        for lo in range(i + 1, int(reach[i]), TILE):
            j = np.arange(lo, min(int(reach[i]), lo + TILE))
            j = j[(block[j] == block[i]) == own]
            if not len(j):
                continue
            a, b = maps[i], maps[j]
            need = -(-percent * (n[i] + n[j]) // (100 + percent))
            most = np.minimum(n[i] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n[j] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
            j = j[most >= need]
            size = at[j + 1] - at[j]
            j, size = j[size > 0], size[size > 0]
            if not len(j):
                continue
            both = np.add.reduceat(marked[element[ranges(at[j], size)]], np.cumsum(size) - size)
            j = j[100 * both >= percent * (n[i] + n[j] - both)]
            links[i] += len(j)
            links[j] += 1
            for other in np.setdiff1d(label[j], label[i]).tolist():
                label[label == other] = label[i]
        marked[mine] = 0
    least = np.full(int(label.max()) + 1, _LAST)
    np.minimum.at(least, label, key)
    has = links > 0
    return list(zip(key[has].tolist(), least[label[has]].tolist(), links[has].tolist(), strict=True))


def _cluster_links(sets: DataFrame, percent: int, width: int, count: int) -> DataFrame:
    """(a, b, n): links of the set a found in one place and a set b that they join it to, from (key, comp, cluster, text) rows."""
    sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("cluster", F.ceil(F.col("size") / BLOCK).cast("int").alias("cut"))
    sized = sets.join(materialize(sizes, "cluster_sizes"), "cluster").withColumn("block", F.pmod(F.xxhash64("key"), "cut").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    placed = sized.select("cluster", "key", "comp", "text", "block", F.explode(pairs).alias("place")).select("cluster", "place.i", "place.j", "key", "comp", "block", "text")
    dealt = placed.repartition(count, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        found: list[tuple[int, int, int]] = []
        for b, buf, at in blocks(batches, "text"):
            value, first = shingles(buf, at, width)
            place = list(zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
            for k, (cluster, i, j, key, comp, block) in enumerate(place):
                if (cluster, i, j) != now:
                    found += _counted(held, now[1] == now[2], percent) if held else []
                    held, now = [], (cluster, i, j)
                held.append((key, comp, block, value[first[k] : first[k + 1]].copy()))
        found += _counted(held, now[1] == now[2], percent) if held else []
        yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["a", "b", "n"])

    return dealt.mapInArrow(run, "a long, b long, n long")


def jaccard_join(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, n_shingles, component_id, n_links, equal_sets) per row; ``th`` is the 64-bit hash of the text (null: empty).

    ``equal_sets`` counts the rows with the same set; ``n_links`` all different
    sets that link to the row's, each verified exactly.
    """
    spark = docs.sparkSession
    count = parts(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    sets = materialize(_sets(rows, width), "sets")
    classes = materialize(sets.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "th")).alias("rep"), F.count(F.lit(1)).alias("equal_sets")), "set_classes")
    maybe = materialize(_maybe_linked(rows, percent, width, count), "maybe_linked")
    chosen = materialize(classes.join(maybe, F.col("k1") == F.col("key")).select("key", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth")), "chosen")
    left = rows.hint("merge").join(chosen, (F.col("id") == F.col("rid")) & (F.col("th") == F.col("rth"))).groupBy("key").agg(F.first("text").alias("text"))
    left = materialize(left, "candidate_sets")
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, label long")

    def labelled() -> DataFrame:
        return left.join(labels, F.col("key") == F.col("node"), "left").select("key", F.coalesce("label", "key").alias("comp"), "text")

    for _ in range(LEADER_ROUNDS):
        pairs = _tiles(labelled(), percent, width, count, True).groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
        links = links.unionByName(materialize(_verify(materialize(pairs, "pairs"), left, percent, width), "verified"))
        labels = components(links)
    clusters = components(materialize(_tiles(labelled(), percent, width, count, False), "bounded"))
    # A component that no bound connects to another is a cluster, too: the links inside it are to be counted.
    clustered = labelled().join(clusters.select(F.col("node").alias("comp"), "label"), "comp", "left").select("key", "comp", F.coalesce("label", "comp").alias("cluster"), "text")
    counted = materialize(_cluster_links(clustered, percent, width, count), "cluster_links")
    labels = components(links.unionByName(counted.select("a", "b")))
    degree = counted.groupBy(F.col("a").alias("dkey")).agg(F.sum("n").alias("n_links"))
    least = classes.join(labels, F.col("k1") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "k1"))
    roots = least.groupBy("comp").agg(F.min("rep.id").alias("root"))
    known = least.join(roots, "comp").join(degree, F.col("k1") == F.col("dkey"), "left").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "root", "equal_sets", "n_links")
    known = materialize(known, "set_components")
    out = sets.join(known, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    root = F.coalesce(F.when(F.col("root") == _LAST, F.lit(None)).otherwise(F.col("root")), F.col("own_id"))
    return out.select(F.col("own_id").alias("id"), "th", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("equal_sets", F.lit(1)).cast("long").alias("equal_sets"))
