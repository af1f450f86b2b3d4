"""Alignment of two tokenizers by union-find over their overlapping tokens.

A text's A tokens and B tokens are the two sides of a graph; an A and a B token
are linked if their byte ranges overlap.  Its connected components are exactly
the minimal groups: runs of A and of B tokens that cover the same bytes and have
no common border inside.  Components come from a union-find over a block of
texts at once (hooking to the least label, then halving paths, until nothing
changes).  The members of components expand the links.

Counting goes by block, not by text: a block names each of its pairs (A id, B
id) once with its count.  Spark adds these up over all blocks, finds the highest
count of each B id, and sends each block the totals of its own pairs; a block's
texts then sum over their links.  So what is shuffled is a row a block and pair,
however often a pair occurs, no pair is in one block twice, and nothing is
broadcast or collected.

Token bytes: A's entries by the byte-level alphabet; B's pieces as UTF-8 with
U+2581 as a space, ``<0xHH>`` as that byte.  A text whose joined A or B bytes are
not those of a space and the text has no tokens, nor has an empty or null one.

Nulls: a null id is carried on.  Repeated rows are aligned each on its own and
count each.  Ties: all pairs that reach a B id's highest count are best.  Empty
tables give empty results, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks, groups
from .bpe_stream import encode_texts, held_vocabulary
from .store import materialize

#: Text bytes of a block (one text at least).
BLOCK = 2 << 20
#: Texts that the piece model is given at a time.
TOGETHER = 64
_BLOCK_SCHEMA = "block long, ids array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, sha array<string>, at array<int>, slot array<int>, times array<int>, pairs array<long>, counts array<long>"


class ByteTokenizer:
    """Ids of texts with a space before them, by the streaming transducer; special tokens' strings are plain text."""

    def __init__(self, path: str):
        self.vocabulary = held_vocabulary(path, special=False)
        self.raw = self.vocabulary.raw

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [x.tolist() for x in self.arrays(texts)]

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        return encode_texts(self.vocabulary, (" " + t for t in texts))


class PieceTokenizer:
    """Ids of texts by a piece model, which puts the space before them itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        # Few texts at a time, as the model answers with lists of numbers.
        return [np.array(x, np.int32) for i in range(0, len(texts), TOGETHER) for x in self(texts[i : i + TOGETHER])]


def unite(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each link (a[i], b[i]) by union-find: the least link of its component.

    Links are in order of their bytes, so each token's links stand together, on
    either side.  A round hooks every link to the least label among its A token's
    links and among its B token's, and halves the way to the root.
    """
    n = len(a)
    root = np.arange(n, dtype=np.int32)
    if not n:
        return root
    sides = []
    for side in (a, b):
        first, length = groups(side)
        many = length > 1
        # Tokens with one link hook nothing.
        sides.append((np.repeat(first[many], length[many]) + _within(length[many]), np.cumsum(length[many]) - length[many], length[many]))
    while True:
        before = root
        for at, first, length in sides:
            if len(at):
                root = root.copy()
                root[at] = np.repeat(np.minimum.reduceat(root[at], first), length)
        root = root[root]
        if (root == before).all():
            return root


def _within(length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


class Aligned:
    """The links and groups of a block of texts, from the ids of both sides."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray):
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([np.zeros(0, np.int32), *side]).astype(np.int64) for side in (a, b))
        # Both sides cover the same bytes in every text, so ends may run on over the block.
        ends = [np.cumsum(size[ids]) for size, ids in ((a_size, self.a), (b_size, self.b))]
        marks = [np.zeros(1 + int(e[-1]) if len(e) else 1, bool) for e in ends]
        for mark, e in zip(marks, ends, strict=True):
            mark[e] = True
        # Bytes between two ends belong to one token of each side: one link each.
        at = np.flatnonzero(marks[0] | marks[1])
        self.link_a, self.link_b = (np.cumsum(m[at]) - m[at] for m in marks)
        root = unite(self.link_a, self.link_b)
        first, _ = groups(self.link_a)
        self.group_a = root[first] if len(first) else root
        first, _ = groups(self.link_b)
        self.group_b = root[first] if len(first) else root
        text_of_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.text_of_link = text_of_a[self.link_a]
        self.n_links = np.bincount(self.text_of_link, minlength=len(self.n_a))
        roots = np.flatnonzero(root == np.arange(len(root)))
        self.n_groups = np.bincount(self.text_of_link[roots], minlength=len(self.n_a))

    def digests(self, spelling: list[bytes]) -> list[str]:
        """SHA-256 of every text's groups, ids as in ``spelled``; empty for texts without tokens."""
        key = np.concatenate([2 * self.group_a.astype(np.int64), 2 * self.group_b.astype(np.int64) + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], len(spelling) // 6
        name = np.concatenate([self.a, self.b + ids])[order]
        # A comma inside a side, a bar after the A side, a semicolon after the B side.
        sign = np.where(np.append(key[1:] != key[:-1], True), 1 + key % 2, 0) if len(key) else key
        spelled_ = (sign * 2 * ids + name).tolist()
        at = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return [hashlib.sha256(b"".join([spelling[x] for x in spelled_[s:e]])[:-1]).hexdigest() if e > s else "" for s, e in zip(at, at[1:], strict=False)]


def spelled(a_ids: int, b_ids: int) -> list[bytes]:
    """Decimals of the ids of both sides, as many for each, followed by a comma, then again by a bar and by a semicolon."""
    n = max(a_ids, b_ids)
    return [b"%d%s" % (i % n, sign) for sign in (b",", b"|", b";") for i in range(2 * n)]


def align_block(texts: list[str], a: ByteTokenizer, b: PieceTokenizer) -> Aligned:
    """The alignment of texts; those without tokens of equal bytes have none."""
    got_a, got_b = a.arrays(texts), b.arrays(texts)
    for i, text in enumerate(texts):
        whole = (" " + text).encode()
        if not text or any(b"".join(map(side.raw.__getitem__, ids[i].tolist())) != whole for side, ids in ((a, got_a), (b, got_b))):
            got_a[i] = got_b[i] = np.zeros(0, np.int32)
    return Aligned(got_a, got_b, *(np.array([len(x) for x in side.raw], np.int64) for side in (a, b)))


def _lists(values: np.ndarray, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _aligner(a_path: str, b_path: str):
    """A row a block: what its texts have, and their links as slots of the block's sorted pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteTokenizer(a_path), PieceTokenizer(b_path)
        spelling = spelled(len(a.raw), len(b.raw))
        number = TaskContext.get().partitionId() << 33
        for part, buf, at in blocks(batches, "text", BLOCK):
            raw = buf.tobytes()
            got = align_block([raw[s:e].decode() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], a, b)
            n = part.num_rows
            pairs, slot = np.unique(got.a[got.link_a] << 32 | got.b[got.link_b], return_inverse=True)
            counts = np.bincount(slot, minlength=len(pairs))
            own, times = np.unique(got.text_of_link * max(1, len(pairs)) + slot, return_counts=True)
            ends = np.searchsorted(own, np.arange(n + 1) * max(1, len(pairs)))
            columns = [
                pa.array([number], pa.int64()), _lists(part.column(0).to_numpy(zero_copy_only=False) if not part.column(0).null_count else part.column(0), [0, n]), *(_lists(x.astype(np.int32), [0, n]) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)),
                pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(got.digests(spelling), pa.string())), _lists(ends.astype(np.int32), [0, n + 1]),
                *(_lists(x.astype(np.int32), [0, len(own)]) for x in (own % max(1, len(pairs)), times)), _lists(pairs, [0, len(pairs)]), _lists(counts.astype(np.int64), [0, len(pairs)]),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in _BLOCK_SCHEMA.split(", ")])
            number += 1

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts from blocks that know the totals of their pairs, in the order of slots."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].values for k in batch.schema.names if k != "block"}
            slot, times, at = (row[k].to_numpy() for k in ("slot", "times", "at"))
            total, best = (row["totals"].field(k).to_numpy(zero_copy_only=False) for k in ("total", "best")) if len(slot) else (np.zeros(1, np.int64), np.zeros(1, bool))
            sums = [np.concatenate([[0], np.cumsum(w)]) for w in (times * best[slot], times * total[slot])]
            yield pa.record_batch([row["ids"], *(row[k].cast(pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array((s[at[1:]] - s[at[:-1]]).astype(np.int64)) for s in sums), row["sha"]], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), (a, b, total, best)): every text, and every pair of ids that is linked.

    ``a_path`` is a byte-level tokenizer's file, ``b_path`` a piece model's; every executor has both.
    """
    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = materialize(own.mapInArrow(_aligner(a_path, b_path), _BLOCK_SCHEMA), "aligned")
    named = made.select("block", F.inline(F.arrays_zip("pairs", "counts"))).toDF("block", "pair", "count")
    totals = named.groupBy("pair").agg(F.sum("count").alias("total"))
    # A B id has no more pairs than A has ids.
    highest = F.max("total").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    totals = materialize(totals.withColumn("best", F.col("total") == highest), "pairs")
    told = named.select("block", "pair").join(totals, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pair", "total", "best"))).alias("totals"))
    texts = made.drop("pairs", "counts").join(told, "block", "left").mapInArrow(_summed, "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return texts, totals.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "total", "best")
