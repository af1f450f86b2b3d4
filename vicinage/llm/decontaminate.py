"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over word positions: words at the mask's positions are
hashed, the others are ignored.  Seeds of training texts are joined with those
of the benchmark; around each hit the two texts are compared word by word.  They
overlap where ``WINDOW`` aligned words in a row (all of a shorter item) agree in
at least ``SIMILARITY`` of the places, so substituted words are tolerated.  The
masks hit every such window, and a seed carries the words around it, so a hit is
verified where it is joined.

A filter of ``FILTER_BITS`` bits, whatever the size of the benchmark, goes to
all tasks; only seeds that it lets pass are joined.  Documents are read once.

Words are runs of letters and digits, case is ignored; characters of scripts
without spaces are words of their own.  Items of fewer than ``SHORTEST`` words
are matched exactly: they overlap where a whole line of a text has the item's
words and no others, as such short phrases stand inside innocent sentences.

Nulls: a null text is empty and overlaps nothing; a null id is carried on.
Repeated items and repeated rows match each on its own.  Empty tables give empty
results.  Other columns are ignored (``decontaminate``: carried on unchanged),
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NOT_WORD, blocks, fold, mix, ranges, span_hash, words
from .store import free_names, materialize

WINDOW = 13
SIMILARITY = 0.8
SHORTEST = 5
#: Items of at least LONG words use the first masks, shorter ones the second.
LONG = 12
MASKS = {True: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)), False: ((0, 1, 2), (0, 1, 3))}
#: Words that a seed carries: WINDOW - 1 before its first one, and as many after the last of the longest mask.
BEFORE = WINDOW - 1
AROUND = BEFORE + 6 + WINDOW - 1
#: Bits of the filter of benchmark seeds that every task gets.
FILTER_BITS = 1 << 24

_SEED = 3
#: Stands for "no word" in training texts and in items; the two never agree.
_NO_WORD = (np.uint32(0), np.uint32(1))


def _cut_unspaced(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words parted at every character from U+3000 to U+9FFF (three bytes in UTF-8)."""
    lead = (low >= 0xE3) & (low <= 0xE9)
    if not lead.any():
        return s, e
    first = np.zeros(len(low) + 4, bool)
    first[s] = True
    solid = np.zeros(len(low) + 4, np.int32)
    solid[s] += 1
    solid[e] -= 1
    at = np.flatnonzero(lead)
    first[at] = True
    first[at + 3] = True
    start = np.flatnonzero(first & (np.cumsum(solid) > 0))
    end = np.append(start[1:], len(low))
    return start, np.minimum(end, e[np.searchsorted(e, start, "right")])


def word_hashes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each document (n+1), and the first words of the lines."""
    low = fold(buf)
    s, e, _ = words(low, at, NOT_WORD)
    s, e = _cut_unspaced(low, s, e)
    line = np.union1d(at, np.flatnonzero(low == 10) + 1)
    return np.maximum(span_hash(low, s, e, _SEED), np.uint64(2)), np.searchsorted(s, at, "left"), np.searchsorted(s, line, "left")


def _seeds(word: np.ndarray, mask: tuple[int, ...], tag: int) -> np.ndarray:
    n = len(word) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, tag * 1315423911 + 17, np.uint64)
    for i in mask:
        out = mix(out + word[i : i + n])
    return out


def _line_seeds(word: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every line of 1 to SHORTEST - 1 words."""
    length = np.diff(line)
    short = (length > 0) & (length < SHORTEST)
    start, length = line[:-1][short], length[short]
    out = np.full(len(start), 99, np.uint64) + length.astype(np.uint64)
    for i in range(SHORTEST - 1):
        more = length > i
        out[more] = mix(out[more] + word[start[more] + i])
    return out, start


def _texts_seeds(word: np.ndarray, first: np.ndarray, line: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, hash, word) of all seeds of training texts; seeds across documents are left out.  Kind 0: long, 1: short, 2: exact lines."""
    last = np.repeat(first[1:], np.diff(first))
    for long, masks in MASKS.items():
        for k, mask in enumerate(masks):
            h = _seeds(word, mask, k + 2 * long)
            at = np.flatnonzero(np.arange(len(h)) + mask[-1] < last[: len(h)])
            yield (0 if long else 1), h[at], at
    yield 2, *_line_seeds(word, line)


def _items_seeds(word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same of benchmark items, each with the kind of its length."""
    length = np.repeat(np.diff(first), np.diff(first))
    for kind, h, at in _texts_seeds(word, first, first):
        n = length[at]
        fits = (n >= LONG, (n >= SHORTEST) & (n < LONG), n < SHORTEST)[kind]
        yield kind, h[fits], at[fits]


def _around(word: np.ndarray, first: np.ndarray, at: np.ndarray, none: np.uint32) -> np.ndarray:
    """AROUND words about each place, of the same document only, by 32 bits of their hashes."""
    word = np.maximum((word >> np.uint64(32)).astype(np.uint32), np.uint32(2))
    doc = np.searchsorted(first, at, "right") - 1
    place = at[:, None] + np.arange(-BEFORE, AROUND - BEFORE)
    inside = (place >= first[doc][:, None]) & (place < first[doc + 1][:, None])
    return np.where(inside, word[np.clip(place, 0, max(len(word) - 1, 0))], none) if len(at) else np.zeros((0, AROUND), np.uint32)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * AROUND), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _item_table(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, buf, at in blocks(batches, "text"):
            word, first, _ = word_hashes(buf, at)
            for kind, h, p in _items_seeds(word, first):
                i = np.searchsorted(first, p, "right") - 1
                yield pa.record_batch([pa.array(h.view(np.int64)), b.column(0).take(pa.array(i)), pa.array(np.full(len(h), kind, np.int32)), pa.array(np.diff(first)[i].astype(np.int32)), pa.array((p - first[i]).astype(np.int32)), _binary(_around(word, first, p, _NO_WORD[1]))], names=["hash", "item", "kind", "n", "place", "item_words"])

    return items.mapInArrow(run, "hash long, item long, kind int, n int, place int, item_words binary")


def _text_table(rows: DataFrame, passing) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(passing.value, np.uint8)
        for b, buf, at in blocks(batches, "text"):
            word, first, line = word_hashes(buf, at)
            for kind, h, p in _texts_seeds(word, first, line):
                slot = h & np.uint64(FILTER_BITS - 1)
                good = bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0
                h, p = h[good], p[good]
                for k in range(0, len(h), 4096):
                    own, hash_ = p[k : k + 4096], h[k : k + 4096]
                    d = np.searchsorted(first, own, "right") - 1
                    doc = pa.array(d)
                    yield pa.record_batch([pa.array(hash_.view(np.int64)), pa.array(np.full(len(own), kind, np.int32)), b.column(0).take(doc), b.column(1).take(doc), pa.array(own - first[d]), _binary(_around(word, first, own, _NO_WORD[0]))], names=["hash", "kind", "id", "th", "at", "text_words"])

    return rows.mapInArrow(run, "hash long, kind int, id long, th long, at long, text_words binary")


def agreeing(text: np.ndarray, item: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(same, good): places around each hit that agree, and those where a verified window begins; ``n`` is the item's length.

    Both are rows x AROUND.  An item shorter than a window is verified as a whole.
    """
    same = text == item
    total = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, 1)], 1)
    good = np.zeros_like(same)
    for w in np.unique(np.minimum(n, WINDOW)).tolist():
        need = -(-int(SIMILARITY * 100) * w // 100)
        own = np.flatnonzero(np.minimum(n, WINDOW) == w)
        inside = (text[own] != _NO_WORD[0]) & (item[own] != _NO_WORD[1])
        held = np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(inside, 1)], 1)
        good[own, : AROUND - w + 1] = (total[own, w:] - total[own, :-w] >= need) & (held[:, w:] - held[:, :-w] == w)
    return same, good


def _verified(hits: DataFrame) -> DataFrame:
    """Per hit with a verified window: the first place that such windows cover, the one after the last, and the places that agree there.

    ``marks`` holds the place of the hit's context and a bit for each of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                col = {x: part.column(part.schema.get_field_index(x)) for x in part.schema.names}
                n, at, place = (col[x].to_numpy().astype(np.int64) for x in ("n", "at", "place"))
                text, item = (np.frombuffer(b"".join(col[x].to_pylist()), np.uint32).reshape(-1, AROUND) for x in ("text_words", "item_words"))
                same, good = agreeing(text, item, n)
                # A line of its own agrees as a whole; what stands around it does not count.
                line = col["kind"].to_numpy() == 2
                good[line] = False
                good[line, BEFORE] = (same[line, BEFORE : BEFORE + SHORTEST - 1] | (np.arange(SHORTEST - 1) >= n[line][:, None])).all(1)
                w = np.minimum(n, WINDOW)
                edge = np.zeros((len(n), AROUND + WINDOW + 1), np.int64)
                r, c = np.nonzero(good)
                np.add.at(edge, (r, c), 1)
                np.add.at(edge, (r, c + w[r]), -1)
                covered = np.cumsum(edge, 1)[:, :AROUND] > 0
                some = np.flatnonzero(covered.any(1))
                covered, base = covered[some], at[some] - BEFORE
                marks = (base + BEFORE << 32) | ((same[some] & covered) << np.arange(AROUND)).sum(1)
                take = pa.array(some)
                yield pa.record_batch([col["id"].take(take), col["th"].take(take), col["item"].take(take), pa.array((at - place)[some]), pa.array(base + covered.argmax(1)), pa.array(base + AROUND - covered[:, ::-1].argmax(1)), pa.array(marks)], names=["id", "th", "item", "diagonal", "start", "end", "marks"])

    return hits.mapInArrow(run, "id long, th long, item long, diagonal long, start long, end long, marks long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    seeds = materialize(_item_table(items), "benchmark_seeds")
    # One row for each 32,768 bits of the filter: its size does not follow the benchmark's.
    slot = F.pmod("hash", F.lit(FILTER_BITS)) + 1
    buckets = seeds.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for r in buckets.collect():
        bits[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    passing = spark.sparkContext.broadcast(bytes(bits))
    # Written before they are joined, so that a hot seed is split as a skewed join.
    found = materialize(_text_table(_keyed(docs, id_col, text_col), passing), "text_seeds")
    hits = found.join(seeds, ["hash", "kind"])
    found = _verified(hits).groupBy("id", "th", "item", "diagonal").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("marks").alias("marks"))
    # A word that several seeds of a diagonal see is one word; a diagonal has no more seeds than twice the item's words.
    seen = F.transform("marks", lambda m: F.transform(F.filter(F.sequence(F.lit(0), F.lit(AROUND - 1)), lambda i: F.getbit(m, i) == 1), lambda i: F.shiftright(m, 32) + i))
    return found.select("id", "th", "item", "start", (F.col("end") - F.col("start")).alias("length"), F.size(F.array_distinct(F.flatten(seen))).cast("long").alias("matches"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start, length, matches): per document and item the diagonal with most agreeing words inside verified windows.

    ``start`` counts words from 0, ``length`` reaches to the end of the last
    verified window.  Ties go to the shorter, then to the earlier overlap.
    """
    found = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text)
    best = F.max_by(F.struct("start", "length", "matches"), F.struct("matches", -F.col("length"), -F.col("start"))).alias("best")
    return found.groupBy("id", "item").agg(best).select("id", "item", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; rows are told apart by id and text, nulls are alike."""
    key, leak = free_names(docs, "key", "leak")
    text_hash = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    leaks = _overlaps(docs, benchmark, id_col, text_col, "item_id", "text").select(F.struct("id", "th").alias(leak)).distinct()
    rows = docs.withColumn(key, F.struct(F.col(id_col).cast("long").alias("id"), text_hash.alias("th")))
    return rows.join(leaks, F.col(key).eqNullSafe(F.col(leak)), "left_anti").drop(key)
