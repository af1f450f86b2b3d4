"""Byte-pair encoding and decoding as streaming transducers of constant memory.

**Lookahead.** Let a text grow at its right end.  Which tokens of the shorter
text can change?  Follow the last border that the merges of both texts share.  A
merge of rank r moves it left only if its left part ends at that border while
its right part begins there in one text alone, and it then moves by the length
of the left part.  The next move, of a later rank q, has a right part that
begins where the left part of r began, so that left part is on the left edge of
q's right part, joined there no earlier than at rank r.  The longest sum of left
parts over such chains of merges is the merge list's sufficient lookahead: a
token that ends at least so many bytes before the end stays, whatever follows.
One pass over the merges computes it (129 bytes for a public list of 50,000).

**Encoding.** Text is fed in chunks.  Pretokens are handed on as soon as two
more characters show their end; a pretoken that goes on for long is merged in a
window and its tokens are emitted once they are stable.  So a transducer holds
one chunk and a window of bytes at most, however long a text or a word is.

**Decoding.** Ids become bytes, and an incremental state machine turns bytes
into text across chunks; bytes that are no UTF-8 become U+FFFD by maximal
subparts.

Nulls: a null text is empty and has no ids; null ids arrays decode to empty
text, ids that are null or not in the vocabulary are left out.  A null document
id is carried on; repeated rows are encoded each on its own.  Strings of added
tokens inside a text are those tokens.  Empty tables give empty results, and
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters fed at a time, and ids decoded at a time.
CHUNK = 1 << 16
#: A pretoken of more characters than this is merged in a window.
LONG = 256
#: Pretokens whose ids a worker remembers.
REMEMBERED = 500_000
#: Bytes up to which merges are looked for one by one.
SHORT = 48
#: Characters of which pretokens that are not known yet are merged together.
TOGETHER = 1 << 20
#: Rows that a worker answers with at a time, and their ids at least.
ROWS, IDS = 512, 1 << 18

#: The split of byte-level tokenizers; fixed by their vocabularies.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: One character of each class, none of which is in a literal of the split.
_LIKE = {"letter": "a", "number": "1", "other": "!", "space": "\t"}
_RUN = {"letter": r"\p{L}*+", "number": r"\p{N}*+", "other": r"[^\s\p{L}\p{N}]*+", "space": r"\s*+"}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple]) -> int:
    """Bytes after which a token is stable, from merges (left, right) in order of rank; parts have a length and can be added.

    Every merge makes a part of its own, from parts made before it or of length one; other lists are refused.
    """
    made: dict = {}
    ends: dict[object, tuple[list[int], list[int]]] = {}
    most = 0
    for rank, (left, right) in enumerate(merges):
        if left + right in made or any(len(x) > 1 and x not in made for x in (left, right)):
            raise ValueError(f"merge {rank} makes a known part or takes an unknown one")
        far, x, joined = 0, right, rank
        while True:  # down the left edge of the right part
            ranks, reach = ends.get(x, ((), ()))
            i = bisect_right(ranks, joined)
            if i:
                far = max(far, reach[i - 1])
            if x not in made:
                break
            joined, x = made[x]
        made[left + right] = (rank, left)
        ranks, reach = ends.setdefault(left, ([], []))
        ranks.append(rank)
        reach.append(max(len(left) + far, reach[-1] if reach else 0))
        most = max(most, len(left) + far)
    return most


def packed(ids: list[int] | np.ndarray) -> bytes:
    """Ids as bytes, four each."""
    return np.asarray(ids, np.int32).tobytes()


class Merger:
    """Ids of byte strings by a merge list: lowest rank first, from the left among equals."""

    def __init__(self, first: list[int], ranks: dict[tuple[int, int], int], made: list[int]):
        self.first, self.ranks, self.made = first, ranks, made
        keys = np.array([a << 32 | b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.sorted, self.rank_of = np.append(keys[order], np.iinfo(np.int64).max), np.append(np.array(list(ranks.values()), np.int64)[order], len(made))
        self.first_, self.made_ = np.array(first, np.int64), np.array(made, np.int64)

    def __call__(self, raw: bytes) -> list[int]:
        ids = [self.first[b] for b in raw]
        if len(ids) > SHORT:
            return self._by_heap(ids)
        none, of = len(self.made), self.ranks.get
        open_ = [of(p, none) for p in zip(ids, ids[1:], strict=False)]
        while open_:
            rank = min(open_)
            if rank == none:
                break
            i = open_.index(rank)
            ids[i : i + 2] = [self.made[rank]]
            del open_[i]
            if i:
                open_[i - 1] = of((ids[i - 1], ids[i]), none)
            if i < len(open_):
                open_[i] = of((ids[i], ids[i + 1]), none)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.sorted, key)
        return np.where(self.sorted[at] == key, self.rank_of[at], len(self.made))

    def together(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of many strings, none of them empty: a round merges the lowest rank of each, the first from the left."""
        out = [b""] * len(raws)
        if not raws:
            return out
        none, size, name = len(self.made), np.array(list(map(len, raws)), np.int64), np.arange(len(raws))
        ids = self.first_[np.frombuffer(b"".join(raws), np.uint8)]
        start = np.cumsum(size) - size
        rank = np.append(self._ranks(ids[:-1], ids[1:]), none)
        rank[start + size - 1] = none
        while True:
            lowest, at = np.divmod(np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), start), len(ids))
            live = lowest < none
            if 2 * np.count_nonzero(live) <= len(live):
                # Those that are done leave.
                flat = packed(ids)
                for i, s, n in zip(name[~live].tolist(), (4 * start[~live]).tolist(), (4 * size[~live]).tolist(), strict=True):
                    out[i] = flat[s : s + n]
                if not live.any():
                    return out
                kept = np.repeat(live, size)
                at = (np.cumsum(kept) - 1)[at[live]]
                ids, rank, name, size, lowest = ids[kept], rank[kept], name[live], size[live], lowest[live]
                live = np.ones(len(name), bool)
            else:
                at, lowest = at[live], lowest[live]
            ids[at] = self.made_[lowest]
            rank[at] = none
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, rank, size = ids[kept], rank[kept], size - live
            start = np.cumsum(size) - size
            # One id less for each string before.
            at = at - np.arange(len(at))
            right, left = at[at < (start + size)[live] - 1], at[at > start[live]] - 1
            rank[right], rank[left] = self._ranks(ids[right], ids[right + 1]), self._ranks(ids[left], ids[left + 1])

    def _by_heap(self, ids: list[int]) -> list[int]:
        """For long strings: n log n steps."""
        n, of = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if (r := of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (r := of((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, (ids[a], ids[b])))
        return [x for x in ids if x >= 0]


class Vocabulary:
    """What a tokenizer file says: merges, ids, added tokens and classes of characters."""

    def __init__(self, path: str, special: bool = True):
        """Without ``special``, strings of added tokens are plain text."""
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, pre = said["model"], said["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if model["type"] != "BPE" or any(odd) or said["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in said["added_tokens"]):
            raise ValueError("added tokens take their surroundings")
        self.added = {t["content"]: t["id"] for t in said["added_tokens"] if special}
        alphabet, ids = byte_alphabet(), model["vocab"]
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in model["merges"]]
        self.lookahead = sufficient_lookahead(pairs)
        self.longest = max(map(len, ids))
        first = [0] * 256
        for c, b in alphabet.items():
            first[b] = ids[c]
        self.merge = Merger(first, {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}, [ids[a + b] for a, b in pairs])
        #: Ids of pretokens; emptied when full.
        self.known: dict[str, bytes] = {}
        #: Bytes of each id; empty where there is none.
        self.raw = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for text, i in chain(ids.items(), self.added.items()):
            self.raw[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
        self.length = np.array([len(x) for x in self.raw])
        self._seen: set[str] = set()
        #: Characters that the tokenizer's own tables class otherwise than ours, and one that ours class so.
        self.otherwise: dict[int, str] = {}
        self.split = regex.compile(_SPLIT)
        #: The same for texts of characters up to U+FFFF, whose classes it names one by one.
        self.plain_split = _plain_split()
        self.runs = {k: regex.compile(v) for k, v in _RUN.items()}
        self.edge = regex.compile("|".join(map(regex.escape, sorted(self.added, key=lambda t: -len(t))))) if self.added else None

    def _class(self, c: str) -> str:
        from tokenizers import pre_tokenizers

        probe = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return next((k for k in ("letter", "number", "other") if len(probe.pre_tokenize_str(_LIKE[k] + c)) == 1), "space")

    def shadow(self, text: str) -> str:
        """``text`` with each character that is classed otherwise replaced by one of the tokenizer's class.

        Tables of characters differ by version; each character is looked up once in the tokenizer's.
        """
        for c in set(text) - self._seen:
            self._seen.add(c)
            ours = next((k for k, r in self.runs.items() if r.fullmatch(c)), "other")
            theirs = self._class(c)
            if ours != theirs:
                self.otherwise[ord(c)] = _LIKE[theirs]
        return text.translate(self.otherwise) if self.otherwise else text

    def splitter(self, text: str):
        return self.plain_split if text.isascii() or max(text) <= "\uffff" else self.split

    def settle(self, held: list[tuple[list[bytes], list]]) -> None:
        """Adds the ids of pieces, which are packed ids or pretokens that were not known, to the lists beside them, packed."""
        new = {p for _, pieces in held for p in pieces if p.__class__ is str}
        if new:
            short = [(w, raw) for w in new if len(raw := w.encode()) <= SHORT]
            found = dict(zip((w for w, _ in short), self.merge.together([raw for _, raw in short]), strict=True))
            found |= {w: packed(self.merge(w.encode())) for w in new - found.keys()}
            if len(self.known) + len(found) > REMEMBERED:
                self.known.clear()
            self.known.update(found)
        for ids, pieces in held:
            ids.append(b"".join([found[p] if p.__class__ is str else p for p in pieces] if new else pieces))

    def kind(self, c: str) -> str:
        return next(k for k, r in self.runs.items() if r.fullmatch(c))


def _plain_split() -> re.Pattern:
    """``_SPLIT`` over classes of the first 65,536 characters, as the wider expression classes them."""
    every = "".join(map(chr, range(1 << 16)))

    def ranges(kind: str) -> str:
        return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(kind, every))

    letter, number, other, space = (ranges(kind) for kind in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))
    return re.compile(rf" ?[{letter}]++| ?[{number}]++|'(?:[stmd]|re|ve|ll)| ?[{other}]++|[{space}]+(?![^{space}])|[{space}]+")


class Encoder:
    """Ids of one text fed in chunks; ``feed`` gives those that are stable, ``finish`` the rest.

    Held between calls: what may still be a part of an added token, the last
    pretoken with two characters, and in a long one, fewer bytes than the
    lookahead and the longest token have together.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.rest, self.run, self.window = "", "", b""
        self.hold = max(map(len, v.added), default=1) - 1

    def feed(self, text: str) -> list[int]:
        return self._ids(text, False)

    def finish(self) -> list[int]:
        return self._ids("", True)

    def _ids(self, text: str, last: bool) -> list[int]:
        out: list[bytes] = []
        self.v.settle([(out, self.pieces(text, last))])
        return np.frombuffer(out[0], np.int32).tolist()

    def pieces(self, text: str, last: bool) -> list:
        """What ``Vocabulary.settle`` makes the ids from that are stable after ``text``; all that are left if it is the ``last``."""
        self.rest += text
        return self._take(last)

    def _take(self, last: bool) -> list:
        out: list = []
        while self.v.edge and (m := self.v.edge.search(self.rest)):
            if not last and m.end() + self.hold > len(self.rest):
                break  # a longer added token may begin here
            tail, self.rest = self.rest[m.end() :], self.rest[: m.start()]
            out += self._plain(len(self.rest), True)
            out.append(packed([self.v.added[m.group()]]))
            self.rest = tail
        at = len(self.rest)
        if not last and self.v.edge:
            # From the first place on at which the chunk's end may be the beginning of an added token.
            at = next((i for i in range(max(0, at - 2 * self.hold), at) if any(t.startswith(self.rest[i : i + len(t)]) for t in self.v.added)), at)
        return out + self._plain(at, last)

    def _plain(self, upto: int, last: bool) -> list:
        """Pieces of ``rest[:upto]``, which holds no added token; unless ``last``, more text follows."""
        text, tail = self.rest[:upto], self.rest[upto:]
        look = self.v.shadow(text)
        split = self.v.splitter(look)
        out: list = []
        start = 0
        if self.run:
            start = self.v.runs[self.run].match(look).end()
            if start < len(text) or last:
                if self.run == "space" and start < len(text):
                    # The last white space before a word is no part of the run; one character is always kept back for this.
                    start -= 1
                out.append(packed(self._window(text[:start], True)))
                self.run = ""
            else:
                keep = 1 if self.run == "space" else 0
                out.append(packed(self._window(text[: len(text) - keep], False)))
                self.rest = text[len(text) - keep :] + tail
                return out
        words = split.findall(look, start)
        end = len(text)
        if not last:
            while words and end + 2 > len(text):
                end -= len(words.pop())
        if look is text or look == text:
            out += map(self.v.known.get, words, words) if max(map(len, words), default=0) <= LONG else map(self._word, words)
        else:
            at = start
            for w in words:
                out.append(self._word(text[at : at + len(w)]))
                at += len(w)
        if not last and len(text) - end > LONG:
            word = split.match(look, end).group()
            if len(word) > LONG and end + len(word) == len(text):
                # Still open: all but its last character are a part of it, as is the last unless it is white space.
                self.run = self.v.kind(word[-1])
                out.append(packed(self._window(text[end:-1], False)))
                end = len(text) - 1
        self.rest = text[end:] + tail
        return out

    def _word(self, word: str) -> str | bytes:
        return self.v.known.get(word, word) if len(word) <= LONG else packed(self._window(word, True))

    def _window(self, text: str, last: bool) -> list[int]:
        """Tokens of a long pretoken that are stable, or all of them."""
        out: list[int] = []
        for i in range(0, len(text), LONG):
            self.window += text[i : i + LONG].encode()
            if len(self.window) > 2 * (self.v.lookahead + self.v.longest):
                self._stable(out)
        if last:
            out += self.v.merge(self.window)
            self.window = b""
        return out

    def _stable(self, out: list[int]) -> None:
        ids = self.v.merge(self.window)
        ends = np.cumsum(self.v.length[ids])
        n = int(np.searchsorted(ends, len(self.window) - self.v.lookahead, "right"))
        out += ids[:n]
        if n:
            self.window = self.window[int(ends[n - 1]) :]


def encode_texts(v: Vocabulary, texts: Iterable[str], chunk: int = CHUNK) -> list[np.ndarray]:
    """All ids of each text, fed in chunks; pretokens new to a worker are merged together over many chunks or texts."""
    out: list[list[bytes]] = []
    held: list[tuple[list[bytes], list]] = []
    size = 0
    for text in texts:
        e = Encoder(v)
        out.append([])
        for i in range(0, max(1, len(text)), chunk):
            held.append((out[-1], e.pieces(text[i : i + chunk], i + chunk >= len(text))))
            size += min(chunk, len(text) - i)
            if size >= TOGETHER:
                v.settle(held)
                held, size = [], 0
    v.settle(held)
    return [np.frombuffer(b"".join(x), np.int32) for x in out]


def encode_text(v: Vocabulary, text: str, chunk: int = CHUNK) -> list[int]:
    """All ids of one text, fed in chunks."""
    return encode_texts(v, [text], chunk)[0].tolist()


def decode_ids(v: Vocabulary, ids: list[int | None], chunk: int = CHUNK) -> str:
    """The text of ids, by a state machine that carries unfinished characters from chunk to chunk."""
    n = len(v.raw)
    return _decoded(v, [x for x in ids if x is not None and 0 <= x < n], chunk)


def _decoded(v: Vocabulary, ids: list[int], chunk: int = CHUNK) -> str:
    state = codecs.getincrementaldecoder("utf-8")("replace")
    out = [state.decode(b"".join(map(v.raw.__getitem__, ids[i : i + chunk]))) for i in range(0, len(ids), chunk)]
    return "".join([*out, state.decode(b"", True)])


_HELD: dict[tuple[str, bool], Vocabulary] = {}


def held_vocabulary(path: str, special: bool = True) -> Vocabulary:
    """The vocabulary that a worker keeps from task to task, with the pretokens that it knows."""
    if (path, special) not in _HELD:
        _HELD[path, special] = Vocabulary(path, special)
    return _HELD[path, special]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text by the tokenizer file at ``path``, which every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held_vocabulary(path)

        def answer(part: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
            ids, first, held = encode_texts(v, texts), 0, 0
            for i, own in enumerate(ids):
                held += len(own)
                if held >= IDS or i + 1 == len(ids):
                    at = np.concatenate([[0], np.cumsum([len(x) for x in ids[first : i + 1]])]).astype(np.int32)
                    flat = np.concatenate(ids[first : i + 1])
                    yield pa.record_batch([part.column(0).slice(first, i + 1 - first), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "ids"])
                    first, held = i + 1, 0

        for b in batches:
            texts, size = [], 0
            for i, words in enumerate(b.column(1)):
                texts.append(words.as_py() or "")
                size += len(texts[-1])
                if len(texts) >= ROWS or size >= TOGETHER or i + 1 == b.num_rows:
                    yield from answer(b.slice(i + 1 - len(texts), len(texts)), texts)
                    texts, size = [], 0

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_column: str = "id", ids: str = "ids") -> DataFrame:
    """(id, ids, text) of every row's ids, special ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held_vocabulary(path)
        for b in batches:
            start, size = 0, 0
            texts: list[str] = []
            for i, one in enumerate(b.column(1)):
                own = one.values
                own = own.to_numpy() if own is not None and not own.null_count else np.array([x for x in own.to_pylist() if x is not None] if own is not None else [], np.int32)
                texts.append(_decoded(v, own[(own >= 0) & (own < len(v.raw))].tolist()))
                size += len(texts[-1])
                if size >= IDS or i + 1 == b.num_rows:
                    part = b.slice(start, len(texts))
                    yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=["id", "ids", "text"])
                    start, size, texts = i + 1, 0, []

    return tokens.select(F.col(id_column).cast("long").alias("id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "id long, ids array<int>, text string")
