"""Language ID by multilingual mixture inference.

Byte trigram models are learned for every language of labelled documents.  A
document is a mixture: each word is drawn from one of the languages in unknown
proportions.  Expectation-maximisation estimates the proportions from the words'
likelihoods; sets of the leading languages, up to all of them, are then compared
by the likelihood less a penalty for each language (BIC), which selects the
document's set.

Nulls and empty texts: language ``und``, score 0, as for any text without a
letter; so does every text if nothing is labelled.  Repeated rows are scored
alike.  Empty tables give empty results.  Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NOT_LETTER, blocks, fold, ranges, words

UNKNOWN = "und"
BITS = 15
#: Labelled documents of each language from which its model is learned, at most (chosen by hash).
LEARN_DOCS = 4000
#: Expectation-maximisation of a document ends when no proportion moves by more than this.
TOLERANCE = 1e-3


def trigrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter byte, with the space that bounds its word; first trigram and document of each word."""
    low = fold(buf)
    s, e, doc = words(low, at, NOT_LETTER)
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[s], after[e - 1] = 32, 32
    live = ~NOT_LETTER[low]
    code = (before[live].astype(np.uint32) << np.uint32(16)) | (low[live].astype(np.uint32) << np.uint32(8)) | after[live]
    length = e - s
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32), np.cumsum(length) - length, doc


class Mixture:
    """Log-probabilities of trigram buckets by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts.astype(np.float64) + 0.5
        self.logp = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    def words(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each word (languages x words) and the word's document."""
        code, first, doc = trigrams(buf, at)
        if not len(first):
            return np.zeros((len(self.langs), 0), np.float32), doc
        return np.stack([np.add.reduceat(p[code], first) for p in self.logp]), doc

    def infer(self, ll: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(proportions under all languages, proportions under the selected set), each documents x languages."""
        k = len(self.langs)
        full, chosen = np.zeros((n, k)), np.zeros((n, k))
        if not ll.shape[1]:
            return full, chosen
        present, at = np.unique(doc, return_index=True)
        size = np.diff(np.append(at, len(doc))).astype(np.float64)
        top = ll.max(0)
        rel = np.exp(ll - top)
        which = np.repeat(np.arange(len(present)), size.astype(np.int64))
        pi, _ = self._em(rel, which, at, size, np.full((len(present), k), 1.0 / k))
        full[present] = pi
        rank = np.argsort(-pi, 1, kind="stable")
        alone = np.add.reduceat((ll - top).astype(np.float64), at, axis=1)
        best = np.zeros_like(pi)
        lead = alone.argmax(0)
        best[np.arange(len(present)), lead] = 1
        fit = 2 * alone.max(0)
        for m in range(2, k + 1):
            # No mixture is likelier than each word in its best language (0), so the rest cannot gain by m or more.
            mixed = np.flatnonzero(fit < -(m - 1) * np.log(np.maximum(size, 2)) * 2)
            if not len(mixed):
                break
            at2, rows = _part(at, size, mixed)
            size2 = size[mixed]
            start = np.zeros((len(mixed), k))
            np.put_along_axis(start, rank[mixed, :m], 1.0 / m, 1)
            pi2, like = self._em(rel[:, rows], np.repeat(np.arange(len(mixed)), size2.astype(np.int64)), at2, size2, start)
            value = 2 * like - (m - 1) * np.log(np.maximum(size2, 2)) * 2
            better = value > fit[mixed]
            best[mixed[better]], fit[mixed[better]] = pi2[better], value[better]
        chosen[present] = best
        return full, chosen

    def _em(self, rel, which, at, size, pi) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) of each document; those that have settled leave the rounds."""
        pi, like = pi.astype(np.float64), np.zeros(len(size))
        live = np.arange(len(size))
        while len(live):
            share = rel * pi[live].T.astype(np.float32)[:, which]
            total = np.maximum(share.sum(0), np.float32(1e-30))
            new = (np.add.reduceat(share / total, at, axis=1) / size).T.astype(np.float64)
            like[live] = np.add.reduceat(np.log(total.astype(np.float64)), at)
            moved = np.abs(new - pi[live]).max(1) > TOLERANCE
            pi[live] = new
            if moved.all():
                continue
            own = np.flatnonzero(moved)
            live = live[own]
            at, rows = _part(at, size, own)
            size, rel = size[own], rel[:, rows]
            which = np.repeat(np.arange(len(own)), size.astype(np.int64))
        return pi, like


def _part(at: np.ndarray, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = size[docs].astype(np.int64)
    return np.cumsum(n) - n, ranges(at[docs], n)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b, buf, at in blocks(batches, "text"):
        lang = np.asarray(b.column(0).to_pylist(), object)
        for one in set(lang.tolist()):
            own = np.flatnonzero(lang == one)
            part = [buf[at[i] : at[i + 1]] for i in own]
            code, _, _ = trigrams(np.concatenate(part) if part else buf[:0], np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int64))
            counts[one] = counts.get(one, 0) + np.bincount(code, minlength=1 << BITS)
    for one, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([one] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], names=["lang", "bucket", "n"])


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = LEARN_DOCS) -> Mixture | None:
    """The models, from up to about ``most`` documents of each language, chosen by the hash of their text."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    part = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most / n))])
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))
    got = sample.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), 1 << BITS))
    place = {lang: i for i, lang in enumerate(langs)}
    counts[[place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    return Mixture(langs, counts)


def has_letter(raw: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold any letter."""
    if (~NOT_LETTER[raw] & (raw < 128)).any():
        return True
    return any(c.isalpha() for c in raw[raw >= 128].tobytes().decode("utf-8", "ignore")) if (raw >= 128).any() else False


def identify(docs: DataFrame, model: Mixture | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, langs, proportions) per row, with the columns ``keep`` carried on.

    ``lang_pred`` leads the selected set; ``score`` is its proportion under all
    languages; ``langs`` and ``proportions`` are the whole set, largest first.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[k for k in keep if k != "text"])
    shared = spark.sparkContext.broadcast(model)
    names = ["id", *keep, "lang_pred", "score", "langs", "proportions"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b, buf, at in blocks(batches, "text"):
            n = b.num_rows
            if model is None:
                full = chosen = np.zeros((n, 1))
                langs = [UNKNOWN]
            else:
                ll, doc = model.words(buf, at)
                full, chosen = model.infer(ll, doc, n)
                langs = model.langs
            lead = chosen.argmax(1)
            pred, got, sets, shares = [], [], [], []
            for i in range(n):
                if model is None or not has_letter(buf[at[i] : at[i + 1]]):
                    pred.append(UNKNOWN), got.append(0.0), sets.append([]), shares.append([])
                    continue
                order = [k for k in np.argsort(-chosen[i], kind="stable").tolist() if chosen[i, k] > 0] or [0]
                pred.append(langs[lead[i]]), got.append(min(1.0, float(full[i, lead[i]])))
                sets.append([langs[k] for k in order]), shares.append([float(chosen[i, k]) for k in order])
            kept = [b.column(b.schema.get_field_index(k)) for k in ("id", *keep)]
            yield pa.record_batch([*kept, pa.array(pred, pa.string()), pa.array(got, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=names)

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in ("id", *keep)) + ", lang_pred string, score double, langs array<string>, proportions array<double>"
    return rows.mapInArrow(score, schema)
