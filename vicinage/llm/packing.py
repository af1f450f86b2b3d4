"""Packing of token sequences by non-negative least squares.

Every document becomes ids of a public tokenizer and one end id.  Whole windows
of a document are sequences of their own; the rest is a length from 1 to one
less than the window.  All combinations of two or three lengths that fill a
window exactly are enumerated, their repeat counts are solved against the
histogram of lengths under non-negativity, rounded down, and raised again where
lengths are left.  What remains is packed greedily: first whole, several pieces
filling a window exactly, and only what fits nowhere is cut at powers of two and
laid end to end in descending size, which fills windows without crossing a
border.  The last, partly filled window is cut into sequences whose lengths are
powers of two.

Nulls: a null text is empty and still has its end id; a null id is carried on.
Repeated rows are packed each on its own.  Empty tables give empty results.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks, fold, ranges, span_hash, words
from .store import materialize

WINDOW = 2048
END_ID = 1
#: The solver stops when CHECKED rounds lower the loss by less than this share of it.
TOLERANCE, CHECKED = 1e-4, 20
#: Words whose ids a worker remembers.
REMEMBERED = 1_500_000
#: Text bytes that are encoded at a time.
TOKEN_BLOCK = 2 << 20


#: ASCII signs at which a word may be parted from what stands before: the tokenizer never joins a letter with one of
#: them.  Left out are the apostrophe and the signs of special tokens.
_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in '!"#$%&()*+,-./:;=?@[]^_`{}~\\']] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


def _plain_bytes(buf: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the Latin-1 letters of two UTF-8 bytes."""
    out = _LETTERS[buf]
    if len(buf) > 1:
        two = (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        out[:-1] |= two
        out[1:] |= two
    return out


class WordTokenizer:
    """Ids of whole texts from a tokenizer that treats white space as a border and ignores case: distinct words are encoded once.

    Words of letters alone are encoded many at a time, joined by spaces, and told
    apart by the ids that end a word; all others one by one.  Words are known by
    64-bit identifiers among those that one worker remembers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for text, i in self.tokenizer.get_vocab().items():
            self.ends[i] = text.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)

    def _encode(self, texts: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and the length of each text's."""
        if not texts:
            return self.ids[:0], self.length[:0]
        if plain:
            got = [x.ids for x in self.tokenizer.encode_batch_fast([" ".join(texts[k : k + 2000]) for k in range(0, len(texts), 2000)], add_special_tokens=False)]
            ids = np.concatenate([np.array(x, np.uint16) for x in got])
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(texts):
                return self._encode(texts, False)
            return ids, np.diff(np.append(-1, last)).astype(np.int32)
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.array(x, np.uint16) for x in got]), np.fromiter(map(len, got), np.int32, len(got))

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and n+1 offsets."""
        s, e, doc = words(buf, at)
        if not len(s):
            return self.ids[:0], np.zeros(len(at), np.int64)
        letter = _plain_bytes(buf)
        # Part words at signs that follow a letter.
        cut = np.flatnonzero(_SIGNS[buf[1:]] & letter[:-1]) + 1
        first_bytes = np.zeros(len(buf), bool)
        first_bytes[s] = True
        cut = cut[~first_bytes[cut]]
        first_bytes[cut] = True
        s = np.flatnonzero(first_bytes)
        e = np.sort(np.concatenate([e, cut]))
        doc = np.searchsorted(at, s, "right") - 1
        odd = np.concatenate([[0], np.cumsum(~letter)])
        plain = odd[e] == odd[s]
        low = fold(buf)
        value = np.where(plain, span_hash(low, s, e, 11), ~span_hash(buf, s, e, 12))
        value, first, which = np.unique(value, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, value)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != value) if len(self.known) else np.arange(len(value))
        if len(new):
            own = plain[first[new]]
            new = np.concatenate([new[own], new[~own]])
            n_plain = int(own.sum())
            raw, raw_low = buf.tobytes(), low.tobytes()
            spans = list(zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True))
            got = [self._encode([raw_low[a:b].decode() for a, b in spans[:n_plain]], True), self._encode([raw[a:b].decode() for a, b in spans[n_plain:]], False)]
            n = np.concatenate([x[1] for x in got])
            start = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, *[x[0] for x in got]])
            order = np.argsort(value[new])
            new, start, n = new[order], start[order], n[order]
            where = place[new]
            self.known, self.start, self.length = np.insert(self.known, where, value[new]), np.insert(self.start, where, start), np.insert(self.length, where, n)
            place = np.searchsorted(self.known, value)
        each = place[which]
        n = self.length[each].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        return self.ids[ranges(self.start[each], n)], total[np.searchsorted(doc, np.arange(len(at)), "left")]


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process, whatever number of tasks it runs."""
    return WordTokenizer(path)


def _cuts(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


_TOKENS = "id long, part int, n long, whole array<long>, rest int, rest_crc long, cuts array<long>, rank long, whole_rank long"


def token_table(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its length in ids, checksums of its whole windows, of its rest and of the rest's cuts, and its ranks within the task."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _tokenizer(tokenizer)
        part = TaskContext.get().partitionId()
        seen, whole_seen = np.zeros(window, np.int64), 0
        end = np.array([END_ID], np.uint32)
        for b, buf, at in blocks(batches, "text", TOKEN_BLOCK):
            ids, first = words_of.encode(buf, at)
            out: list[tuple] = []
            for i in range(b.num_rows):
                own = np.concatenate([ids[first[i] : first[i + 1]], end]).astype("<u4")
                n, raw = len(own), own.tobytes()
                k, rest = divmod(n, window)
                whole = [zlib.crc32(raw[4 * window * j : 4 * window * (j + 1)]) for j in range(k)]
                tail, cuts, p = raw[4 * window * k :], [], 0
                for c in _cuts(rest):
                    cuts.append(zlib.crc32(tail[4 * p : 4 * (p + c)]))
                    p += c
                out.append((n, whole, rest, zlib.crc32(tail), cuts, int(seen[rest]), whole_seen))
                seen[rest] += 1
                whole_seen += k
            c = list(zip(*out, strict=True))
            yield pa.record_batch(
                [b.column(0), pa.array([part] * len(out), pa.int32()), pa.array(c[0], pa.int64()), pa.array(c[1], pa.list_(pa.int64())), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], pa.int64()), pa.array(c[6], pa.int64())],
                names=["id", "part", "n", "whole", "rest", "rest_crc", "cuts", "rank", "whole_rank"],
            )

    return materialize(rows.mapInArrow(encode, _TOKENS), "tokens")


def combinations(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All pairs and triples of present lengths that fill the window, ascending in each row; a pair begins with 0."""
    have = histogram > 0
    have[0] = False
    a, b = np.triu_indices(len(have))
    c = window - a - b
    good = (c >= b) & (c < len(have)) & (have[a] | (a == 0)) & have[b]
    a, b, c = a[good], b[good], c[good]
    good = have[c]
    return np.stack([a[good], b[good], c[good]], 1)


def solve(histogram: np.ndarray, combos: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, A's columns being the combinations (accelerated projected gradient)."""
    if not len(combos):
        return np.zeros(0)
    goal = histogram.astype(np.float64)
    goal[0] = 0
    flat = combos.ravel()

    def forward(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, 3), minlength=len(goal))
        out[0] = 0
        return out

    def back(y: np.ndarray) -> np.ndarray:
        return y[combos].sum(1)

    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    was = np.inf
    for i in range(1, 1 << 30):
        new = np.maximum(0, y - step * back(forward(y) - goal))
        if (y - new) @ (new - x) > 0:
            t = 1.0  # the momentum points uphill: start it anew
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
        if i % CHECKED == 0:
            loss = float(((forward(x) - goal) ** 2).sum())
            if was - loss <= tolerance * was:
                return x
            was = loss


def round_counts(histogram: np.ndarray, combos: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts that the histogram allows, and the lengths left over: rounded down, then raised in the order of what was cut off."""
    left = histogram.astype(np.int64).copy()
    counts = np.zeros(len(combos), np.int64)
    order = np.argsort(-x, kind="stable")
    down = np.floor(x + 1e-6).astype(np.int64)
    rest = left.tolist()
    rest[0] = 1 << 62  # the empty place of a pair

    def raise_(order: np.ndarray, wish: list[int]) -> None:
        for i, (a, b, c) in zip(order.tolist(), combos[order].tolist(), strict=True):
            k = min(wish[i], rest[a], rest[b], rest[c])
            if a == b or b == c:
                k = min(k, rest[b] // (1 + (a == b) + (b == c)))
            if k > 0:
                counts[i] += k
                rest[b] -= k
                rest[c] -= k
                if a:
                    rest[a] -= k

    raise_(order[down[order] > 0], down.tolist())
    raise_(np.argsort(-(x - down), kind="stable"), [1] * len(x))
    raise_(order, [1 << 62] * len(x))
    left[1:] = rest[1:]
    return counts, left


def fill_whole(left: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Combinations of any number of the lengths left that fill the window exactly, each with its repeat count; ``left`` is lowered."""

    def ending(gap: int) -> list[int] | None:
        if gap < len(left) and left[gap] > 0:
            return [gap]
        a = np.arange(max(1, gap - len(left) + 1), gap // 2 + 1)
        pairs = np.where(2 * a == gap, left[a] // 2, np.minimum(left[a], left[gap - a])) if len(a) else a
        if len(pairs) and pairs.max() > 0:
            one = int(a[np.argmax(pairs)])
            return [one, gap - one]
        return None

    def fitting(gap: int) -> list[int]:
        return np.flatnonzero(left[: max(0, min(gap - 1, len(left)))] > 0)[::-1].tolist()

    def exact(gap: int) -> list[int] | None:
        if got := ending(gap):
            return got
        for one in fitting(gap):
            # After the first, always the longest that fits; very short lengths make this a chain of up to the window's length.
            taken, rest = [], gap
            while one and not got:
                left[one] -= 1
                taken.append(one)
                rest -= one
                got = ending(rest)
                one = None if got else next(iter(fitting(rest)), None)
            np.add.at(left, taken, 1)
            if got:
                return [*taken, *got]
        return None

    out = []
    for a in range(len(left) - 1, 0, -1):
        while left[a] > 0:
            left[a] -= 1
            got = exact(window - a)
            left[a] += 1
            if not got:
                break
            pieces = [a, *got]
            need = np.bincount(pieces)
            own = np.flatnonzero(need)
            k = int((left[own] // need[own]).min())
            out.append((pieces, k))
            left[own] -= k * need[own]
    return out


class Plan:
    """Where the piece of a given length and rank goes."""

    def __init__(self, histogram: np.ndarray, wholes: int, window: int = WINDOW):
        self.window = window
        combos = combinations(histogram, window)
        counts, self.left = round_counts(histogram, combos, solve(histogram, combos))
        used = counts > 0
        chosen = [([a for a in c if a], k) for c, k in zip(combos[used].tolist(), counts[used].tolist(), strict=True)]
        #: Rests that the solved combinations place, that are packed whole after them, and that are cut.
        self.solved = int(histogram.sum() - self.left[1:].sum())
        chosen += fill_whole(self.left, window)
        self.cut = int(self.left.sum())
        self.used = histogram.astype(np.int64) - self.left
        slots: list[tuple[int, int, int, int]] = []
        base, taken = wholes, [0] * len(histogram)
        for c, k in chosen:
            at = 0
            for a in c:
                slots.append((a, taken[a], base, at))
                taken[a] += k
                at += a
            base += k
        table = np.array(sorted(slots), np.int64).reshape(-1, 4)
        self.slot_key, self.slot_base, self.slot_at = (table[:, 0] << 48) | table[:, 1], table[:, 2].copy(), table[:, 3].astype(np.int32)
        self.base = base
        bits = max(1, (window - 1).bit_length())
        size = np.arange(len(histogram))
        self.ahead = np.zeros((bits, len(histogram)), np.int64)
        self.at = np.zeros(bits, np.int64)
        total = 0
        for b in range(bits - 1, -1, -1):
            own = np.where(size >> b & 1, self.left, 0)
            self.ahead[b] = np.cumsum(own) - own
            self.at[b] = total
            total += int(own.sum()) << b
        self.full, tail = divmod(total, window)
        self.tail = np.concatenate([[0], np.cumsum(_cuts(tail))]).astype(np.int64)

    def whole(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces that are not cut."""
        i = np.searchsorted(self.slot_key, (length << 48) | rank, "right") - 1
        return self.slot_base[i] + rank - (self.slot_key[i] & ((1 << 48) - 1)), self.slot_at[i]

    def cuts(self, length: np.ndarray, rank: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the cut of ``1 << bit`` ids of pieces that have it; ``rank`` counts the cut pieces of a length."""
        sequence, offset = np.divmod(self.at[bit] + ((self.ahead[bit, length] + rank) << bit), self.window)
        last = sequence == self.full
        i = np.searchsorted(self.tail, offset[last], "right") - 1
        sequence[last] += i
        offset[last] -= self.tail[i]
        return self.base + sequence, offset


_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece; ``tokenizer`` is the path of its file."""
    tokens = token_table(docs, tokenizer, window, id_col, text_col)
    # Ranks within a task become global ones by a table of one row per task and length; length 0 stands for whole windows.
    rests = tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"))
    wholes = tokens.groupBy("part").agg(F.sum(F.size("whole")).cast("long").alias("n")).select("part", F.lit(0).alias("rest"), "n")
    sizes = materialize(rests.filter("rest > 0").unionByName(wholes), "lengths")
    histogram = np.zeros(window, np.int64)
    for r in sizes.groupBy("rest").agg(F.sum("n").alias("n")).collect():
        histogram[r["rest"]] = r["n"]
    whole_total, histogram[0] = int(histogram[0]), 0
    plan = docs.sparkSession.sparkContext.broadcast(Plan(histogram, whole_total, window))
    ahead = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    placed = tokens.join(starts, ["part", "rest"], "left").join(starts.filter("rest = 0").select("part", F.col("ahead").alias("whole_ahead")), "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = plan.value
        for b in batches:
            column = {k: b.column(b.schema.get_field_index(k)) for k in b.schema.names}
            rest, rest_crc, rank, whole_rank, ahead, whole_ahead = (column[k].fill_null(0).to_numpy().astype(np.int64) for k in ("rest", "rest_crc", "rank", "whole_rank", "ahead", "whole_ahead"))
            wholes, cut_crc = column["whole"].value_lengths().to_numpy().astype(np.int64), column["cuts"].flatten().to_numpy()
            first_cut = np.cumsum(n_cuts := column["cuts"].value_lengths().to_numpy().astype(np.int64)) - n_cuts
            # Columns: row, start, length, checksum, sequence, offset.
            row, j = np.repeat(np.arange(b.num_rows), wholes), ranges(np.zeros(len(wholes), np.int64), wholes)
            out = [(row, j * window, np.full(len(row), window), column["whole"].flatten().to_numpy(), (whole_ahead + whole_rank)[row] + j, np.zeros(len(row), np.int64))]
            rank = rank + ahead
            row = np.flatnonzero((rest > 0) & (rank < made.used[rest]))
            out.append((row, wholes[row] * window, rest[row], rest_crc[row], *made.whole(rest[row], rank[row])))
            row = np.flatnonzero((rest > 0) & (rank >= made.used[rest]))
            rank = rank - made.used[rest]
            start, nth = wholes[row] * window, first_cut[row]
            for bit in range(len(made.at) - 1, -1, -1):
                own = rest[row] >> bit & 1 > 0
                r = row[own]
                out.append((r, start[own], np.full(len(r), 1 << bit), cut_crc[nth[own]], *made.cuts(rest[r], rank[r], bit)))
                start, nth = start + (own << bit), nth + own
            row, start, length, crc, sequence, offset = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))
            at = pa.array(row)
            yield pa.record_batch([column["id"].take(at), pa.array(start), pa.array(length), pa.array(crc), column["n"].take(at), pa.array(sequence), pa.array(offset)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(place, _PIECES)
