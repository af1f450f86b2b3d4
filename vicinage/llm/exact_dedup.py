"""Exact dedup by a minimal perfect hash over the digests of earlier documents.

Documents are equal when their texts are identical after lower-casing A to Z.
The digests of a history are spread over buckets; for each bucket a minimal
perfect hash (hash and displace) gives every digest a slot of its own.  A slot
holds the full digest, the locator of the winner so far and the count.  Arrivals
are looked up by one slot and the digest's bytes are compared; members join the
slot's group and nonmembers form groups of their own.

Nulls: a null text counts as empty, a null id never wins against another id.
Repeated rows: rows that repeat the winner's id are the same document, all are
kept.  Empty tables give empty results.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocks, mix
from .store import materialize

#: Digests that a bucket of the index holds on average.
BUCKET = 4096
_ROW = pa.schema([("id", pa.int64()), ("digest", pa.binary())])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, buf, at in blocks(batches, "text"):
        raw = buf.tobytes().lower()  # bytes.lower changes A to Z alone
        out = [hashlib.sha256(raw[s:e]).digest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], schema=_ROW)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of each whole normalised text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_digest_batches, "id long, digest binary")


def _halves(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of 32-byte digests, apart from the bits that choose the bucket."""
    w = np.ascontiguousarray(digest).view(np.uint64).reshape(-1, 4)
    return w[:, 1], w[:, 2]


def build_mph(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and slots of a minimal perfect hash of distinct 32-byte digests (n x 32 bytes).

    About four keys share a group; groups are placed largest first, each with
    the first displacement that sends its keys to free slots.
    """
    n = len(digest)
    m = max(1, n // 4)
    seeds, slots, free = np.zeros(m, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    if not n:
        return seeds, slots
    g, h = _halves(digest)
    group = (g % np.uint64(m)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=m)
    ends = np.cumsum(sizes)
    step = 256
    for k in np.argsort(-sizes, kind="stable"):
        if not sizes[k]:
            break
        keys = order[ends[k] - sizes[k] : ends[k]]
        d = 0
        while True:
            at = _place(h[keys][None, :], np.arange(d, d + step, dtype=np.uint64)[:, None], n)
            good = free[at].all(1)
            if sizes[k] > 1:
                s = np.sort(at, 1)
                good &= (s[:, 1:] != s[:, :-1]).all(1)
            if good.any():
                i = int(np.argmax(good))
                seeds[k] = d + i
                slots[keys] = at[i]
                free[at[i]] = False
                break
            d += step
    return seeds, slots


def _place(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ (seed * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def find(seeds: np.ndarray, n: int, digest: np.ndarray) -> np.ndarray:
    """The one slot at which each digest would stand; whether it does is for the caller to compare."""
    if not n or not len(digest):
        return np.zeros(len(digest), np.int64)
    g, h = _halves(digest)
    return _place(h, seeds[(g % np.uint64(len(seeds))).astype(np.int64)].astype(np.uint64), n)


def _as_matrix(column: pa.Array) -> np.ndarray:
    buf, _ = as_bytes_binary(column)
    return buf.reshape(-1, 32)


def as_bytes_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


_INDEX = "bucket long, seeds binary, slots binary, winners binary, counts binary"
_NO_ID = np.iinfo(np.int64).min


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for i in range(b.num_rows):
            got = b.column(1)[i].values
            digest = _as_matrix(got.field("digest"))
            seeds, slots = build_mph(digest)
            stored, winner, count = np.empty_like(digest), np.empty(len(digest), np.int64), np.empty(len(digest), np.int64)
            stored[slots], winner[slots], count[slots] = digest, got.field("winner").to_numpy(), got.field("n").to_numpy()
            out.append((b.column(0)[i].as_py(), seeds.tobytes(), stored.tobytes(), winner.tobytes(), count.tobytes()))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "seeds", "slots", "winners", "counts"])


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with its distinct digests; digests are uniform, so buckets are of like size."""
    groups = rows.groupBy("digest").agg(F.max(F.coalesce("id", F.lit(_NO_ID))).alias("winner"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")).agg(F.collect_list(F.struct("digest", "winner", "n")).alias("found"))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index: one row per bucket with the displacements and the slots' digests, winners and counts."""
    return _bucketed(history, buckets).mapInArrow(_index_batches, _INDEX)


def _lookup_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "keep", "size"]
    for b in batches:
        c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            stored = np.frombuffer(c["slots"][i].as_py() or b"", np.uint8).reshape(-1, 32)
            winner = np.frombuffer(c["winners"][i].as_py() or b"", np.int64).copy()
            count = np.frombuffer(c["counts"][i].as_py() or b"", np.int64).copy()
            new, new_winner, new_count = stored[:0], winner[:0], count[:0]
            if c["found"][i].is_valid:
                got = c["found"][i].values
                digest, won, n = _as_matrix(got.field("digest")), got.field("winner").to_numpy(), got.field("n").to_numpy()
                slot = find(np.frombuffer(c["seeds"][i].as_py() or b"", np.uint32), len(stored), digest)
                member = (stored[slot] == digest).all(1) if len(stored) else np.zeros(len(digest), bool)
                at = slot[member]
                winner[at] = np.maximum(winner[at], won[member])
                count[at] += n[member]
                new, new_winner, new_count = digest[~member], won[~member], n[~member]
            every = np.concatenate([stored, new])
            raw = every.tobytes()
            keep = np.concatenate([winner, new_winner])
            yield pa.record_batch([pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary()), pa.array(keep, mask=keep == _NO_ID), pa.array(np.concatenate([count, new_count]))], names=names)


def exact_groups(history: DataFrame, arrivals: DataFrame, buckets: int) -> DataFrame:
    """(digest, keep, size) over history and arrivals, both (id, digest)."""
    index = build_index(history, buckets)
    both = index.join(_bucketed(arrivals, buckets), "bucket", "full_outer")
    return both.mapInArrow(_lookup_batches, "digest binary, keep long, size long")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep, size, digest) for every row of ``docs`` (and of ``history``, documents seen before).

    Without a history, the lower half of the range of ids is the history of the
    upper half.  The winner of a group is its largest id.
    """
    rows = digests(docs, id_col, text_col)
    if history is None:
        rows = materialize(rows, "digests")
        low, high, n = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
        middle = (low + high) // 2 if low is not None else 0
        old, new, every = rows.filter(F.col("id") <= middle), rows.filter((F.col("id") > middle) | F.col("id").isNull()), rows
    else:
        old, new = materialize(digests(history, id_col, text_col), "history"), materialize(rows, "digests")
        every = old.unionByName(new)
        n = every.count()
    # Both sides of the join are written tables, so a digest with a third of all rows can be split as a skewed join.
    found = materialize(exact_groups(old, new, max(1, n // BUCKET)), "groups")
    return every.hint("merge").join(found, "digest").select("id", "keep", "size", "digest")
