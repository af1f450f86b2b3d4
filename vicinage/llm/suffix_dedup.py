"""Repeated substrings by bucket-pointer refinement.

Suffixes are put into buckets by their first ``Q`` bytes, and each holds a pointer
to its bucket.  A bucket is refined by sorting its members on the pointers that
stand at a later offset; the refined pointers are what the next round sorts on,
so every round doubles the depth, until strings of ``LENGTH`` bytes are told
apart (``refine``).  Buckets are made of bytes and pointers, not of hashes, so
what is in one bucket at the end is equal byte by byte.

The suffix array is cut into parts that can be refined apart from each other:

* Each window of ``LENGTH`` bytes names the smallest identifier among its
  ``GRAM``-byte grams, its anchor.  Neighbours with the same anchor form a run.
  Equal windows have equal anchors, so an anchor that only one run names
  repeats nothing; all others are open.
* Bytes of open runs are refined in the task that reads them, and only the first
  of each bucket is sent on, to the part that its anchor falls in.  There the
  buckets of all tasks are refined together; the first stays, the others repeat
  it.  A passage in a third of all documents is one segment of each task.
* An anchor that very many runs name (a frequent phrase in ever different
  surroundings) is dealt by more bytes than its own: by cells of ``CELL`` windows
  and the bytes that all windows of a cell share.

Nulls: a null text is empty; a null id comes after all others.  Rows that repeat
an id are told apart by their text; rows alike in both are one document.  Empty
tables give empty results.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SpanHash, blocks, groups, mix, ranges
from .store import materialize, parts

LENGTH = 100
#: Bytes of the first buckets, and of the grams that anchors are chosen from.
Q, GRAM = 8, 20
#: Windows of a cell of a hot anchor.  An anchor is hot from HOT runs on, and at most HOT_KEYS anchors are.
CELL, HOT, HOT_KEYS = 8, 256, 2_000_000
#: Text bytes that are refined at a time, and whose anchors a task sends at a time.
REFINE_BYTES, SEND_BYTES = 2 << 20, 8 << 20
_LAST = (1 << 63) - 1
_HASH = SpanHash(21)
_PAYLOAD, _OPEN, _REPEAT, _HOT, _TOTAL = 0, 1, 2, 3, 4
#: A row is a parcel for one part (``data``), runs of one document (``data``), or a number ``n`` of an anchor (``id``).
_ROW = "kind int, part int, id long, th long, n long, data binary"
_NAMES = ["kind", "part", "id", "th", "n", "data"]
_RUN = np.dtype([("core", "<u8"), ("id", "<i8"), ("th", "<i8"), ("lo", "<u4"), ("members", "<u4"), ("n", "u1")])
_SEGMENT = np.dtype([("key", "<u8"), ("id", "<i8"), ("th", "<i8"), ("lo", "<u4"), ("n", "<u4")])


def grams(buf: np.ndarray, q: int = Q) -> np.ndarray:
    """The first ``q`` (at most 8) bytes of every suffix as a number; past the end stand zeros."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    wide = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(buf),), (1,))
    return wide.astype(np.uint64) >> np.uint64(8 * (8 - q))


def refine_round(pointer: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    """One round: sort the suffixes ``at`` within their buckets on the pointers ``offset`` further, and point at the new buckets.

    A pointer is the place of its bucket's first member in the order of suffixes,
    so members that stay first keep theirs.  Returns the members of buckets that
    still hold more than one; all others are told apart from every other suffix.
    """
    here = pointer[at].astype(np.uint64)
    key = (here << np.uint64(32)) | pointer[at + offset]
    order = np.argsort(key)
    at, key = at[order], key[order]
    start, size = groups(key)
    old, _ = groups(key >> np.uint64(32))
    bucket = old[np.searchsorted(old, start, "right") - 1]
    pointer[at] = np.repeat((key[start] >> np.uint64(32)) + (start - bucket).astype(np.uint64), size).astype(np.uint32)
    return at[np.repeat(size > 1, size)]


def refine(buf: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of the suffixes ``at``, equal for two of them if and only if their first ``length`` bytes are.

    Every suffix in ``at`` has ``length`` bytes at least.
    """
    depth = min(Q, length)
    offsets = []
    while depth < length:
        offsets.append(min(depth, length - depth))
        depth += offsets[-1]
    # Suffixes whose pointers each round needs, from the last round to the first.
    need = np.zeros(len(buf) + 1, bool)
    need[at] = True
    wanted = [need]
    for off in reversed(offsets):
        more = wanted[-1].copy()
        more[off:] |= wanted[-1][:-off]
        wanted.append(more)
    wanted.reverse()
    live = np.flatnonzero(wanted[0])
    first = grams(buf, min(Q, length))[live]
    order = np.argsort(first)
    start, size = groups(first[order])
    live = live[order].astype(np.int32)
    pointer = np.zeros(len(buf) + 1, np.uint32)
    pointer[live] = np.repeat(start.astype(np.uint32), size)
    live = live[np.repeat(size > 1, size)]
    for off, here in zip(offsets, wanted[1:], strict=True):
        live = refine_round(pointer, live[here[live]], off)
    return pointer[at]


def anchors(ids: np.ndarray, at: np.ndarray, length: int = LENGTH, q: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of each run of windows of ``length`` bytes that share an anchor."""
    width = length - q + 1
    none = np.zeros(0, np.int64)
    if len(ids) < width:
        return none, none, none
    low = np.uint64((1 << 32) - 1)
    m = (ids & ~low) | np.arange(len(ids), dtype=np.uint64)
    k = 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < width:
        m = np.minimum(m[: -(width - k)], m[width - k :])
    n = np.diff(at)
    crossing = ranges(np.maximum(at[1:] - length + 1, at[:-1]), np.minimum(n, length - 1))
    whole = np.ones(len(m), bool)
    whole[crossing[crossing < len(m)]] = False
    window = np.flatnonzero(whole)
    anchor = (m[window] & low).astype(np.int64)
    first, count = groups(anchor)
    return anchor[first], window[first], window[first + count - 1]


def _parcels(kind: int, part: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
    zero = pa.array(np.zeros(len(data), np.int64))
    return pa.record_batch([pa.array(np.full(len(data), kind, np.int32)), pa.array(part.astype(np.int32)), zero, zero, zero, pa.array(data, pa.binary())], names=_NAMES)


def _numbers(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(key), np.int64)
    return pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(zero.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(zero), pa.array(n.astype(np.int64)), pa.nulls(len(key), pa.binary())], names=_NAMES)


def _by_document(kind: int, ids: np.ndarray, th: np.ndarray, lo: np.ndarray, n: np.ndarray, count: int) -> pa.RecordBatch:
    """A row per document with its runs: first window and number of windows."""
    order = np.lexsort((lo, th, ids))
    ids, th = np.ascontiguousarray(ids[order], np.int64), np.ascontiguousarray(th[order], np.int64)
    run = np.stack([lo[order], n[order]], 1).astype("<u4")
    at = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]))[: len(ids)])
    data = [x.tobytes() for x in np.split(run, at[1:])] if len(at) else []
    part = ((ids[at] ^ th[at]) % count).astype(np.int32)
    return pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(part), pa.array(ids[at]), pa.array(th[at]), pa.array(np.zeros(len(at), np.int64)), pa.array(data, pa.binary())], names=_NAMES)


def _read_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and number of windows of each run of a column of lists of binary values (null: none)."""
    per_row = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    size = np.array([len(x.as_buffer()) // 8 for x in values], np.int64)
    run = np.frombuffer(b"".join(x.as_py() for x in values), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.repeat(np.arange(len(per_row)), per_row), size), run[:, 0], run[:, 1]


def _send_anchors(count: int):
    """Anchors of all runs: those that several runs of a task name are known to be open; one of each goes to its part."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.concatenate(held)
        r = r[np.argsort(r["core"], kind="stable")]
        start, size = groups(r["core"])
        own = r[np.repeat(size > 1, size)]
        yield _by_document(_OPEN, own["id"], own["th"], own["lo"], own["n"], count)
        out = r[start]
        out["members"] = size
        part = (out["core"] % np.uint64(count)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at, _ = groups(part[order])
        yield _parcels(_PAYLOAD, part[order][at], [x.tobytes() for x in np.split(out[order], at[1:])] if len(at) else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b, buf, at in blocks(batches, "text"):
            gram = _HASH.windows(_HASH.prefix(buf), GRAM)
            a, lo, hi = anchors(gram, at)
            doc = np.searchsorted(at, lo, "right") - 1
            r = np.zeros(len(a), _RUN)
            r["core"], r["id"], r["th"], r["lo"], r["n"] = gram[a], b.column(0).to_numpy()[doc], b.column(1).to_numpy()[doc], lo - at[doc], hi - lo + 1
            held.append(r)
            size += len(buf)
            if size >= SEND_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _meet_anchors(count: int):
    """Open runs among the anchors of one part, and the anchors that very many runs name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            kind = b.column(0).to_numpy()
            held += [np.frombuffer(b.column(5)[i].as_buffer(), _RUN) for i in np.flatnonzero(kind == _PAYLOAD).tolist()]
            yield b.filter(pa.array(kind != _PAYLOAD))
        if not held:
            return
        r = np.concatenate(held)
        held.clear()
        r = r[np.argsort(r["core"], kind="stable")]
        start, size = groups(r["core"])
        own = r[np.repeat(size > 1, size) & (r["members"] == 1)]
        yield _by_document(_OPEN, own["id"], own["th"], own["lo"], own["n"], count)
        named = np.add.reduceat(r["members"].astype(np.int64), start)
        hot = named >= HOT
        yield _numbers(_HOT, r["core"][start][hot], named[hot])
        yield _numbers(_TOTAL, np.zeros(1, np.uint64), named.sum(keepdims=True))

    return run


def _first_of_class(pointer: np.ndarray, run: np.ndarray, rank: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are the first of their bucket, and which repeat another one; they come in the order of rank and place.

    ``run`` tells the window's run, ``rank`` the run's document.  A window that is
    in twice (same document and place) is neither.
    """
    me = np.arange(len(pointer), dtype=np.int32)
    head = np.zeros(int(pointer.max()) + 1 if len(pointer) else 0, np.int32)
    head[pointer[::-1]] = me[::-1]
    head = head[pointer]
    first = head == me
    return first, ~first & ~((rank[run] == rank[run[head]]) & (pos == pos[head]))


def _spans(where: np.ndarray, *edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of neighbours in ``where`` (sorted places) that agree in ``edges``."""
    if not len(where):
        return where, where
    cut = where[1:] != where[:-1] + 1
    for e in edges:
        cut |= e[1:] != e[:-1]
    at = np.flatnonzero(np.append(True, cut))
    return at, np.diff(np.append(at, len(where)))


def _ranks(ids: np.ndarray, th: np.ndarray) -> np.ndarray:
    order = np.lexsort((th, ids))
    new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (th[order][1:] != th[order][:-1]))[: len(ids)]
    out = np.zeros(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def _send_segments(count: int, hot_keys):
    """Refine the open windows of a block of documents; repeats are told by document, the first ones sent to their parts with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_keys.value
        for b, buf, at in blocks(batches, "text", REFINE_BYTES):
            ids, th = b.column(b.schema.get_field_index("id")).to_numpy(), b.column(b.schema.get_field_index("th")).to_numpy()
            doc, lo, _ = _read_runs(b.column(b.schema.get_field_index("runs")))
            gram = _HASH.windows(_HASH.prefix(buf), GRAM)
            a, first, last = anchors(gram, at)
            is_open = np.zeros(len(buf) + 1, bool)
            is_open[at[doc] + lo] = True
            some = np.flatnonzero(is_open[first])
            doc = np.searchsorted(at, first[some], "right") - 1
            rank = _ranks(ids, th)
            some = some[np.argsort(rank[doc], kind="stable")]
            a, first, n = a[some], first[some], (last - first + 1)[some]
            doc = np.searchsorted(at, first, "right") - 1
            where = ranges(first, n).astype(np.int32)
            run_of = np.repeat(np.arange(len(n), dtype=np.int32), n)
            lead, repeat = _first_of_class(refine(buf, where), run_of, rank[doc], where - at[doc][run_of])
            s, m = _spans(where[repeat], doc[run_of[repeat]])
            start, r_doc = where[repeat][s], doc[run_of[repeat][s]]
            yield _by_document(_REPEAT, ids[r_doc], th[r_doc], start - at[r_doc], m, count)
            where, run_of = where[lead], run_of[lead]
            key, cell = gram[a], np.zeros(len(where), np.int32)
            hot_run = np.isin(key, hot)
            if hot_run.any():
                cell = np.where(hot_run[run_of], (a[run_of] - where) // CELL + 1, 0).astype(np.int32)
            s, m = _spans(where, run_of, cell)
            start, cell, run_of = where[s].astype(np.int64), cell[s].astype(np.int64), run_of[s]
            key = key[run_of]
            many = np.flatnonzero(cell)
            if len(many):
                shared = _HASH.windows(_HASH.prefix(buf), LENGTH - CELL + 1)
                c = cell[many]
                key[many] = mix(shared[a[run_of[many]] - (c - 1) * CELL] + c.astype(np.uint64))
            doc = doc[run_of]
            r = np.zeros(len(s), _SEGMENT)
            r["key"], r["id"], r["th"], r["lo"], r["n"] = key, ids[doc], th[doc], start - at[doc], m
            part = (r["key"] % np.uint64(count)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            starts, sizes = groups(part[order])
            data = []
            for i, k in zip(starts.tolist(), sizes.tolist(), strict=True):
                own = order[i : i + k]
                text = buf[ranges(start[own], m[own] + LENGTH - 1)]
                data.append(np.uint32(k).tobytes() + r[own].tobytes() + text.tobytes())
            yield _parcels(_PAYLOAD, part[order][starts], data)

    return run


def _meet_segments(count: int):
    """Refine the segments of one part together, a bounded number of bytes of whole keys at a time; rows that belong to documents pass."""

    def settled(r: np.ndarray, buf: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((r["lo"], r["th"], r["id"]))
        r, at = r[order], at[order]
        n = r["n"].astype(np.int64)
        where = ranges(at, n).astype(np.int32)
        seg = np.repeat(np.arange(len(r), dtype=np.int32), n)
        pos = where + (r["lo"].astype(np.int64) - at)[seg]
        _, repeat = _first_of_class(refine(buf, where), seg, _ranks(r["id"], r["th"]), pos)
        s, m = _spans(pos[repeat], seg[repeat])
        own = r[seg[repeat][s]]
        return _by_document(_REPEAT, own["id"], own["th"], pos[repeat][s], m, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, texts = [], []
        for b in batches:
            kind = b.column(0).to_numpy()
            for i in np.flatnonzero(kind == _PAYLOAD).tolist():
                raw = b.column(5)[i].as_py()
                k = int(np.frombuffer(raw, "<u4", 1)[0])
                heads.append(np.frombuffer(raw, _SEGMENT, k, 4))
                texts.append(np.frombuffer(raw, np.uint8, offset=4 + k * _SEGMENT.itemsize))
            yield b.filter(pa.array(kind != _PAYLOAD))
        if not heads:
            return
        r, buf = np.concatenate(heads), np.concatenate(texts)
        heads.clear(), texts.clear()
        length = r["n"].astype(np.int64) + LENGTH - 1
        at = np.cumsum(length) - length
        order = np.argsort(r["key"], kind="stable")
        start, size = groups(r["key"][order])
        # Keys with one segment repeat nothing.
        start, size = start[size > 1], size[size > 1]
        held, total = [], 0
        for i, k in zip(start.tolist(), size.tolist(), strict=True):
            own = order[i : i + k]
            more = int(length[own].sum())
            if held and total + more > REFINE_BYTES:
                own_all = np.concatenate(held)
                yield settled(r[own_all], buf[ranges(at[own_all], length[own_all])], np.cumsum(length[own_all]) - length[own_all])
                held, total = [], 0
            held.append(own)
            total += more
        if held:
            own_all = np.concatenate(held)
            yield settled(r[own_all], buf[ranges(at[own_all], length[own_all])], np.cumsum(length[own_all]) - length[own_all])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, buf, at in blocks(batches, "text"):
        gone, spans, kept, sha = [], [], [], []
        doc, lo, n = _read_runs(b.column(b.schema.get_field_index("runs")))
        edge = np.zeros(len(buf) + 1, np.int64)
        np.add.at(edge, at[doc] + lo, 1)
        np.add.at(edge, at[doc] + lo + n - 1 + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        some = np.zeros(b.num_rows, bool)
        some[doc] = True
        for i in range(b.num_rows):
            left, n_spans = buf[at[i] : at[i + 1]], 0
            if some[i]:
                out = covered[at[i] : at[i + 1]]
                n_spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                left = left[~out]
            gone.append(int(at[i + 1] - at[i]) - len(left)), spans.append(n_spans)
            raw = left.tobytes()
            kept.append(raw), sha.append(hashlib.sha256(raw).hexdigest())
        yield pa.record_batch([b.column(b.schema.get_field_index("own_id")), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; ``kept`` has the bytes that stay."""
    spark = docs.sparkSession
    count = parts(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"), F.col(id_col).cast("long").alias("own_id"))
    dealt = rows.repartition(count, "id", "th")

    def runs(found: DataFrame, kind: int) -> DataFrame:
        return found.filter(F.col("kind") == kind).groupBy("id", "th").agg(F.collect_list("data").alias("runs"))

    found = rows.mapInArrow(_send_anchors(count), _ROW).repartition(count, "part").mapInArrow(_meet_anchors(count), _ROW)
    found = materialize(found.select("kind", "id", "th", "n", "data"), "anchors")
    total = found.filter(F.col("kind") == _TOTAL).agg(F.sum("n")).first()[0] or 0
    # HOT_KEYS bounds what is collected here, at any size of the input.
    hot = found.filter((F.col("kind") == _HOT) & (F.col("n") >= max(HOT, total / HOT_KEYS))).select("id").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(hot["id"].to_numpy().view(np.uint64)))
    sent = dealt.join(runs(found, _OPEN), ["id", "th"]).mapInArrow(_send_segments(count, hot), _ROW)
    repeats = sent.repartition(count, "part").mapInArrow(_meet_segments(count), _ROW)
    return dealt.join(runs(repeats, _REPEAT), ["id", "th"], "left").mapInArrow(_remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
