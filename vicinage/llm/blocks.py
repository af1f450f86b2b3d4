"""Whole-text blocks: numpy views of Arrow text columns, hashes of spans, and words.

Every operator of this subpackage that leaves the JVM works on blocks: a bounded
run of whole documents laid out as one byte buffer.  Nothing here looks across a
document boundary, and no text is ever cut short: a block holds at least one
document however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a block holds before it is handed on (one document at least).
BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits of the result are usable."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(32))


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit identifiers of byte spans of any length; equal bytes have equal identifiers wherever they stand.

    Eight bytes at a time are read as a number and mixed; the values of longer
    spans are combined in pairs, level by level, each level with its own mixing
    step.  No step is linear in the bytes, so no family of texts collides for
    every seed, as repetitive ones do under a polynomial modulo 2^64.
    """
    n = end - start
    count = np.maximum(-(-n // 8), 1)
    at = np.repeat(start, count) + 8 * ranges(np.zeros(len(n), np.int64), count)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    wide = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(buf) + 1,), (1,))
    live = np.clip(np.repeat(end, count) - at, 0, 8)
    value = mix((wide[at] & _LOW_BYTES[live]) + np.uint64((seed * 0x9E3779B97F4A7C15) & _MASK))
    out = np.zeros(len(n), np.uint64)
    who = np.arange(len(n))
    while len(who):
        first = np.cumsum(count) - count
        done = count == 1
        out[who[done]] = value[first[done]]
        who, first, count = who[~done], first[~done], count[~done]
        half = (count + 1) // 2
        left = np.repeat(first, half) + 2 * ranges(np.zeros(len(half), np.int64), half)
        alone = left + 1 >= np.repeat(first + count, half)
        right = value[np.minimum(left + 1, len(value) - 1)]
        right[alone] = _BASE
        value, count = mix(mix(value[left] + _BASE) ^ (right * np.uint64(0xD1B54A32D192ED03))), half
    return mix(out ^ (n.astype(np.uint64) * _BASE))


class SpanHash:
    """64-bit identifiers of all windows of one small width, from prefix sums of a polynomial over random byte codes.

    For widths of a few dozen bytes only: modulo 2^64 a polynomial tells long
    repetitive spans apart badly, which ``span_hash`` does not.
    """

    _pow: np.ndarray = np.ones(1, np.uint64)
    _inv: np.ndarray = np.ones(1, np.uint64)

    def __init__(self, seed: int = 1):
        self.codes = _table(seed)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._pow) < n:
            m = max(n, 2 * len(cls._pow), 2 * BLOCK_BYTES)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls._pow = np.concatenate([np.ones(1, np.uint64), np.full(m - 1, _BASE, np.uint64)]).cumprod()
            cls._inv = np.concatenate([np.ones(1, np.uint64), np.full(m - 1, inverse, np.uint64)]).cumprod()

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        """Prefix sums, to be given to ``windows``."""
        self._grow(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.codes[buf] * self._pow[: len(buf)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Identifiers of every window of ``width`` bytes."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((prefix[width:] - prefix[:n]) * self._inv[:n])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one buffer and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows of at most ``most`` text bytes (one row at least) with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, at = as_bytes(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), buf[at[i] : at[j]], at[i : j + 1] - at[i]
            i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes that are no part of a word when punctuation counts for nothing: all of ASCII but letters and digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: As before, and digits too.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of two UTF-8 bytes, byte by byte."""
    out = LOWER[buf]
    if len(out) > 1:
        high = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][high] += 32
    return out


def words(buf: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every run of bytes not in ``between`` (by default space and 0x09 to 0x0D)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~between[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[at[:-1]] = True
    first[len(buf)] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    end = solid
    end = end & np.append(~solid[1:] | first[1:-1], True)
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(at, s, "right") - 1


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_keys):
        z = np.zeros(0, np.int64)
        return z, z
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.diff(np.append(at, len(sorted_keys)))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + length)``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
