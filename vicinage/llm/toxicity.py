"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear SVM over sentences.

The kernel of two strings counts common subsequences of three letters within
``SPAN`` letters, each weighted by ``DECAY`` to the power of its gaps, and is
normalised.  A sentence is the set of its windows: every run of whole tokens of
up to ``WINDOW`` letters, so strings span tokens, and insults with inserted
letters, signs or spaces stay near to the plain ones.  The kernel of a sentence
and a landmark string sums, over the sentence's windows, the squared part of
their kernel above ``FLOOR``; below it, windows have next to nothing in common
with the landmark, and a bound tells most of them without the kernel.

Landmarks are the strings that tell toxic from clean training texts best, and
the clean windows that come closest to those.  Sentences are mapped to the
landmarks' Nystrom space, and a linear SVM is trained on sentences: all sentences
of a clean text are clean, and of a toxic text the worst one is toxic (chosen
anew in each round, if any of its strings is commoner in toxic texts).  A text
scores as its worst sentence.

Sentences end with a token that ends with ``.``, ``!``, ``?`` or a full stop of
another script, and with a line.  Every letter of every script is a symbol: a to
z, digits and signs that stand for letters, accented Latin letters without
their accents, and all others by a hash of the character.

Nulls and empty texts have no sentences and get the lowest score; so does every
text if there is no toxic or no clean label.  Rows that repeat an id share its
labels (toxic if any is).  Empty tables give empty results.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import as_bytes, blocks, fold, groups, mix, ranges, span_hash, words

SPAN = 6
DECAY = 0.7
#: Letters of a window; a longer token is cut into overlapping windows.
WINDOW = 12
#: Kernel values that count for nothing.
FLOOR = 0.5
#: Landmarks from toxic texts, the telling strings that they are chosen from, and clean windows that come closest to them.
LANDMARKS, POOL, NEAR_LANDMARKS = 96, 400, 32
#: Labelled rows of each class from which the SVM is trained, at most (chosen by hash).
LEARN_DOCS = 1500
#: Windows whose worth a worker remembers.
REMEMBERED = 1_000_000
#: Log-ratio of rates from which a string can tell why a text is toxic, and from which it is toxic by itself.
TELLING, PLAIN = 1.0, 3.0
#: Variants with one letter inserted of each string that is toxic by itself.
VARIANTS = 6
#: Bits of a symbol; symbols from OTHER on are letters that are not Latin.
_BITS, OTHER = 6, 27
_CODES = 1 << 3 * _BITS
_PAIRS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SEED = 5


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each byte below 128 (0: left out), and of the Latin-1 letters by their second byte."""
    one, two = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for i in range(26):
        one[97 + i] = one[65 + i] = 1 + i
    for sign, letter in zip("0134578@$!", "oieastbasi", strict=True):
        one[ord(sign)] = 1 + ord(letter) - 97
    for b in range(0x80, 0xC0):
        letter = unicodedata.normalize("NFD", chr(b + 0x40))[0].lower()
        two[b] = 1 + ord(letter) - 97 if "a" <= letter <= "z" else OTHER + b % ((1 << _BITS) - OTHER)
    return one, two


_ONE, _TWO = _tables()
#: Groups of landmarks that have a bound each, and the unit that bounds are counted in.
GROUPS, _UNIT = 16, 1e-3
#: Least norm of a string of n letters: no two of its subsequences are alike.
_NORM = np.sqrt([sum(max(n - b, 0) * DECAY ** (2 * (b - 2)) for _, b in _PAIRS) for n in range(WINDOW + 1)])


def _symbols(low: np.ndarray) -> np.ndarray:
    """One symbol per character, at its first byte; 0 for what is no letter and for the other bytes."""
    sym = _ONE[low]
    lead = np.flatnonzero(low >= 0xC2)
    if len(lead):
        padded = np.concatenate([low, np.zeros(3, np.uint8)])
        code = low[lead].astype(np.uint64)
        for k in (1, 2, 3):
            own = padded[lead + k]
            code = code << np.uint64(8) | np.where((own & 0xC0) == 0x80, own, 0).astype(np.uint64)
        other = OTHER + (mix(code) % np.uint64((1 << _BITS) - OTHER)).astype(np.int64)
        latin = low[lead] == 0xC3
        other[latin] = _TWO[padded[lead[latin] + 1]]
        # Signs: U+2000 to U+206F and U+3000 to U+303F.
        sign = ((low[lead] == 0xE2) & (padded[lead + 1] <= 0x81)) | ((low[lead] == 0xE3) & (padded[lead + 1] == 0x80))
        sym[lead] = np.where(sign, 0, other)
    return sym


def sentences(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols end to end; start, end and sentence of each token that has any; document of each sentence."""
    low = fold(buf)
    s, e, doc = words(low, at)
    if not len(s):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), z, z, z, z
    sym = _symbols(low)
    # A trailing "!" ends a sentence; inside a token it stands for a letter.
    last = e - 1
    sym[last[low[last] == 33]] = 0
    stop = np.isin(low[last], (33, 46, 63)) | ((low[last] == 0x82) & (low[last - 1] == 0x80) & (e - s >= 3))
    lines = np.concatenate([[0], np.cumsum(low == 10)])
    new = np.append(True, stop[:-1] | (doc[1:] != doc[:-1]) | (lines[s[1:]] != lines[e[:-1]]))
    sentence = np.cumsum(new) - 1
    kept = np.concatenate([[0], np.cumsum(sym > 0)])
    s, e, of = kept[s], kept[e], doc[new]
    some = e > s
    return sym[sym > 0], s[some], e[some], sentence[some], of


def windows(s: np.ndarray, e: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and sentence of every run of whole tokens of 3 to WINDOW letters; longer tokens in overlapping pieces."""
    long = np.flatnonzero(e - s > WINDOW)
    n = (e - s)[long]
    pieces = -(-(n - WINDOW) // (WINDOW // 2)) + 1
    off = ranges(np.zeros(len(n), np.int64), pieces) * (WINDOW // 2)
    which = np.repeat(np.arange(len(n)), pieces)
    out = [(s[long][which] + off, np.minimum(n[which] - off, WINDOW), sentence[long][which])]
    i = np.flatnonzero(e - s <= WINDOW)
    k = 0
    while len(i):
        n = e[i + k] - s[i]
        good = n >= 3
        out.append((s[i][good], n[good], sentence[i][good]))
        k += 1
        i = i[i + k < len(s)]
        i = i[(sentence[i + k] == sentence[i]) & (e[i + k] - s[i] <= WINDOW)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _codes(sym: np.ndarray) -> Iterator[tuple[np.ndarray, int, float]]:
    """(subsequences, reach, weight) of each pair of gaps: the numbers of those that begin at the first letters, in order."""
    wide = sym.astype(np.int32)
    for a, b in _PAIRS:
        n = max(sym.shape[-1] - b, 0)
        yield (wide[..., :n] << 2 * _BITS) | (wide[..., a : n + a] << _BITS) | wide[..., b : n + b], b, DECAY ** (b - 2)


def _all_codes(sym: np.ndarray, s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subsequences, weights, norms) of strings of one length: a row of subsequences for each string."""
    each = list(_codes(sym[s[:, None] + np.arange(size)]))
    code = np.concatenate([c for c, _, _ in each], 1)
    weight = np.concatenate([np.full(c.shape[1], w, np.float32) for c, _, w in each])
    # Equal subsequences of a string are summed before they are squared.
    bits = max(1, int(len(weight) - 1).bit_length())
    packed = np.sort((code << bits) | np.arange(len(weight), dtype=np.int32), 1)
    w = weight[packed & ((1 << bits) - 1)].ravel()
    packed >>= bits
    new = np.ones(packed.shape, bool)
    new[:, 1:] = packed[:, 1:] != packed[:, :-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(w, at) ** 2
    return code, weight, np.sqrt(np.add.reduceat(total, np.append(0, np.cumsum(new.sum(1))[:-1])))


class Kernel:
    """Kernels of strings with fixed landmark strings; all have 3 to WINDOW letters."""

    def __init__(self, sym: np.ndarray, s: np.ndarray, n: np.ndarray):
        who, what, weight = [], [], []
        for k, (at, size) in enumerate(zip(s.tolist(), n.tolist(), strict=True)):
            code, w, norm = _all_codes(sym, np.array([at]), size)
            who.append(np.full(len(w), k)), what.append(code[0]), weight.append(w / norm[0])
        what, row = np.unique(np.concatenate(what), return_inverse=True)
        table = np.zeros((len(what) + 1, len(n)), np.float32)
        np.add.at(table, (row + 1, np.concatenate(who)), np.concatenate(weight))
        # Landmarks that are alike form a group; empty places fill the last ones up.
        alike, free, groups_ = table.T @ table, list(range(len(n))), []
        self.size = -(-len(n) // GROUPS)
        while free:
            own = sorted(free, key=lambda k: -alike[free[0], k])[: self.size]
            groups_.append(own)
            free = [k for k in free if k not in set(own)]
        #: Place of each landmark among the columns.
        self.column = np.zeros(len(n), np.int64)
        self.table = np.zeros((len(what) + 1, len(groups_), self.size), np.float32)
        for g, own in enumerate(groups_):
            self.table[:, g, : len(own)] = table[:, own]
            self.column[own] = g * self.size + np.arange(len(own))
        #: Subsequences of landmarks have a row in the table; row 0 is that of all others.
        self.row = np.zeros(_CODES, np.int32)
        self.row[what] = np.arange(1, len(what) + 1)
        #: The most that any landmark of a group has of a subsequence, by its weight, rounded up to _UNIT.
        self.most = {b: np.ceil(self.table.max(2) * np.float32(DECAY ** (b - 2)) / _UNIT).astype(np.uint16) for _, b in _PAIRS}

    def strings(self, sym: np.ndarray, s: np.ndarray, n: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """Kernel of each string with each landmark, less FLOOR, scaled and squared; only with the groups that are ``near`` it."""
        g = self.table.shape[1]
        who, group = np.nonzero(np.ones((len(n), g), bool) if near is None else near)
        out = np.zeros((len(n), g, self.size), np.float32)
        size_of = n[who]
        for size in np.unique(size_of).tolist():
            mine = np.flatnonzero(size_of == size)
            for k in range(0, len(mine), 2000):
                own = mine[k : k + 2000]
                code, weight, norm = _all_codes(sym, s[who[own]], size)
                row, of = self.row[code].T.copy(), group[own]
                total = np.zeros((len(own), self.size), np.float32)
                for j, w in enumerate(weight):
                    total += self.table[row[j], of] * w
                out[who[own], of] = np.maximum((total / norm[:, None] - FLOOR) / (1 - FLOOR), 0) ** 2
        return out.reshape(len(n), g * self.size)[:, self.column]

    def near(self, sym: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings that can have a kernel above FLOOR, and with which groups, by a bound from above.

        No landmark of a group has more of a subsequence than ``most``, and no string has a smaller norm than its length's.
        """
        g = self.table.shape[1]
        least = (FLOOR * _NORM / _UNIT).astype(np.uint32)
        order = np.argsort(s, kind="stable")
        kept, masks = [np.zeros(0, np.int64)], [np.zeros((0, g), bool)]
        for lo in range(0, len(sym), 16384):
            part = sym[lo : lo + 16384 + WINDOW]
            each = np.zeros((len(part), g), np.uint16)
            for code, b, _ in _codes(part):
                each[: len(code)] += self.most[b][self.row[code]]
            total = np.zeros((len(part) + 1, g), np.uint32)
            np.cumsum(each, axis=0, dtype=np.uint32, out=total[1:])
            own = order[slice(*np.searchsorted(s, (lo, lo + 16384), sorter=order))]
            at = s[own] - lo
            # Subsequences begin three letters before the window's end at the latest.
            mask = total[at + n[own] - 2] - total[at] >= least[n[own], None]
            some = np.flatnonzero(mask.any(1))
            kept.append(own[some]), masks.append(mask[some])
        return np.concatenate(kept), np.concatenate(masks)


class Model:
    """Landmarks, Nystrom map and SVM weights; ``margins`` are those of sentences."""

    def __init__(self, kernel: Kernel, root: np.ndarray, weight: np.ndarray, bias: float):
        self.kernel, self.beta, self.bias = kernel, (root @ weight).astype(np.float32), float(bias)
        self._forget()

    def _forget(self) -> None:
        #: Windows that this worker has seen (by hash, sorted), and what they are worth.
        self.known, self.known_worth = np.zeros(1, np.uint64), np.zeros(1, np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": np.zeros(1, np.uint64), "known_worth": np.zeros(1, np.float32)}

    def margins(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(margin and document of each sentence; the windows that count: symbols, start, length, sentence and worth)."""
        sym, s, e, sentence, doc = sentences(buf, at)
        s, n, sentence = windows(s, e, sentence)
        near, groups_ = self.kernel.near(sym, s, n)
        s, n, sentence = s[near], n[near], sentence[near]
        value, first, which = np.unique(span_hash(sym, s, s + n, _SEED), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, value)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != value)
        # Equal windows have one bound but for what follows them; groups out of bound add nothing.
        own = first[new]
        worth = self.kernel.strings(sym, s[own], n[own], groups_[own]) @ self.beta
        self.known, self.known_worth = np.insert(self.known, place[new], value[new]), np.insert(self.known_worth, place[new], worth)
        worth = self.known_worth[np.searchsorted(self.known, value)][which]
        return np.bincount(sentence, worth, len(doc)) + self.bias, doc, (sym, s, n, sentence, worth)


def probability(margin: np.ndarray) -> np.ndarray:
    """A margin of 0 gives 0.7, the threshold of a positive."""
    return 1 / (1 + np.exp(-(3.0 * np.clip(margin, -20, 20) + np.log(0.7 / 0.3))))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Squared-hinge linear SVM with intercept by Newton steps; the weights of either class sum to the same."""
    c = np.where(y > 0, 1 / weight[y > 0].sum(), 1 / weight[y < 0].sum()) * weight
    m = x.shape[1]
    reg = np.diag(np.append(np.full(m, 1e-4), 1e-8))
    w = np.zeros(m + 1)
    live = np.ones(len(x), bool)

    def loss(w: np.ndarray) -> float:
        return float(reg.diagonal() @ (w * w) + c @ np.maximum(0, 1 - y * (x @ w[:m] + w[m])) ** 2)

    def moments(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted second moments of the rows with a one beside them, and those with the labels; a block of rows at a time."""
        square, cross = np.zeros((m + 1, m + 1)), np.zeros(m + 1)
        for k in range(0, len(own), 8192):
            part = own[k : k + 8192]
            z = np.hstack([x[part], np.ones((len(part), 1))])
            square += (z * c[part, None]).T @ z
            cross += z.T @ (c[part] * y[part])
        return square, cross

    for _ in range(rounds):
        square, cross = moments(np.flatnonzero(live))
        full = np.linalg.solve(reg + square, cross)
        step, old = 1.0, loss(w)
        while step > 1e-3:
            new = w + step * (full - w)
            if loss(new) <= old + 1e-12:
                break
            step /= 2
        w, was = new, live
        live = y * (x @ w[:m] + w[m]) < 1
        if step == 1.0 and (live == was).all():
            break
    return w


def _variants(sym: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each string with a letter inserted: doubled or any other, at VARIANTS places."""
    rng = np.random.Generator(np.random.PCG64(8))
    out: list[np.ndarray] = []
    for a, k in zip(s.tolist(), n.tolist(), strict=True):
        own = sym[a : a + k]
        for v in range(VARIANTS):
            at = int(rng.integers(1, k))
            out.append(np.insert(own, at, own[at - 1] if v % 2 else rng.integers(1, 27))[:WINDOW])
    length = np.array([len(x) for x in out])
    return np.concatenate(out).astype(np.uint8), np.cumsum(length) - length, length


def _spread(sym: np.ndarray, s: np.ndarray, n: np.ndarray, merit: np.ndarray) -> list[int]:
    """LANDMARKS strings of most merit, where what a string has in common with one that is chosen counts for nothing more."""
    alike = Kernel(sym, s, n).strings(sym, s, n)
    left, out = merit.astype(np.float64), []
    while len(out) < LANDMARKS and left.max(initial=0) > 0:
        out.append(int(np.argmax(left)))
        left = np.minimum(left, merit * (1 - np.minimum(alike[:, out[-1]], 1)))
        left[out] = 0
    return out


def _distinct(sym: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, which = np.unique(span_hash(sym, s, s + n, _SEED), return_index=True, return_inverse=True)
    return first, which


def fit(texts: list[str | None], toxic: np.ndarray) -> Model | None:
    """Train on labelled texts; None if a class is missing or no text has a string of three letters."""
    toxic = np.asarray(toxic).astype(bool)
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    buf, at = as_bytes(pa.array(texts, pa.string()))
    sym, ts, te, t_sentence, doc_of = sentences(buf, at)
    s, n, sentence = windows(ts, te, t_sentence)
    if not len(s):
        return None
    # What tells toxic texts: tokens (windows that are one token or a piece of one), by the number of different strings
    # before them, so that neither copies of a text nor what one text repeats bring up anything new.
    token = np.flatnonzero(np.isin(s, ts) & (n == np.minimum(te[np.searchsorted(ts, s, "right") - 1] - s, WINDOW)))
    token = token[np.argsort(s[token], kind="stable")]
    first, which = _distinct(sym, s[token], n[token])
    bag = doc_of[sentence[token]]
    before = np.where(np.append(True, bag[1:] != bag[:-1]), 0, np.append(0, which[:-1] + 1))
    once = np.unique(bag * len(first) + which, return_index=True)[1]

    def contexts(own: np.ndarray) -> np.ndarray:
        own = once[own[bag[once]]]
        return np.bincount(np.unique(which[own] * (len(first) + 1) + before[own]) // (len(first) + 1), minlength=len(first))

    in_toxic, in_clean = contexts(toxic), contexts(~toxic)
    rate = np.log((in_toxic + 0.5) / (in_toxic.sum() + 1)) - np.log((in_clean + 0.5) / (in_clean.sum() + 1))
    merit = np.where(in_toxic >= 2, in_toxic * np.maximum(rate, 0), 0)
    if not merit.any():
        merit = np.exp(rate)  # too few texts to compare rates
    pool = np.argsort(-merit, kind="stable")[:POOL]
    marks = token[first[pool[_spread(sym, s[token[first[pool]]], n[token[first[pool]]], merit[pool])]]]
    # Clean windows of any tokens that come closest to them.
    kernel = Kernel(sym, s[marks], n[marks])
    clean = np.flatnonzero(~toxic[doc_of[sentence]])
    clean = clean[kernel.near(sym, s[clean], n[clean])[0]]
    clean = clean[_distinct(sym, s[clean], n[clean])[0]]
    close = kernel.strings(sym, s[clean], n[clean]).max(1, initial=0)
    order = np.argsort(-close, kind="stable")
    order = order[close[order] > 0][:NEAR_LANDMARKS]
    marks = np.concatenate([marks, clean[order]])
    marks = marks[_distinct(sym, s[marks], n[marks])[0]]
    kernel = Kernel(sym, s[marks], n[marks])
    value, vector = np.linalg.eigh(kernel.strings(sym, s[marks], n[marks]).astype(np.float64) + 1e-3 * np.eye(len(marks)))
    root = vector / np.sqrt(np.maximum(value, 1e-3))
    # All sentences in Nystrom space: sums over their windows.
    near, groups_ = kernel.near(sym, s, n)
    f2, w2 = _distinct(sym, s[near], n[near])
    each = kernel.strings(sym, s[near][f2], n[near][f2], groups_[f2])
    counts = each.any(1)[w2]
    near, w2 = near[counts], w2[counts]
    # Sentences without any window near a landmark are all alike and have no row of their own (row -1).
    some = np.unique(sentence[near])
    row = np.full(len(doc_of), -1, np.int64)
    row[some] = np.arange(len(some))
    x = np.stack([np.bincount(row[sentence[near]], column[w2], len(some)).astype(np.float32) for column in each.T], 1)
    x = np.concatenate([x @ root, np.zeros((1, len(marks)))]).astype(np.float32)
    # Strings that toxic texts alone bring up again and again are toxic in any sentence, and so are their variants.
    plain = token[first[(in_toxic >= 5) & (rate >= PLAIN)]]
    more = kernel.strings(sym, s[plain], n[plain])
    if len(plain):
        more = np.concatenate([more, kernel.strings(*_variants(sym, s[plain], n[plain]))])
    more = (more @ root).astype(np.float32)
    more_weight = np.concatenate([np.ones(len(plain)), np.full(len(plain) * VARIANTS, 1 / VARIANTS)])
    telling = np.full(len(doc_of), -np.inf)
    np.maximum.at(telling, sentence[token], np.where(in_toxic >= 2, rate, -np.inf)[which])
    can = toxic[doc_of] & (telling >= TELLING)
    if not can.any():
        can = toxic[doc_of]  # too few texts to compare rates
    can = np.flatnonzero(can)
    clean_rows = row[~toxic[doc_of]]
    bare = int((clean_rows < 0).sum())
    rows_clean = np.concatenate([clean_rows[clean_rows >= 0], np.full(min(bare, 1), -1)])
    clean_weight = np.concatenate([np.ones(len(clean_rows) - bare), np.full(min(bare, 1), float(bare))])
    margin = telling.copy()
    w = np.zeros(x.shape[1] + 1)
    was = None
    for _ in range(20):
        # The worst sentence of each toxic text. A text none of whose strings is commoner in toxic texts bears no witness:
        # its label says nothing about its sentences.
        can = can[np.lexsort((-margin[can], doc_of[can]))]
        witness = can[groups(doc_of[can])[0]]
        if was is not None and np.array_equal(witness, was):
            break
        was = witness
        y = np.concatenate([np.ones(len(more) + len(witness)), -np.ones(len(rows_clean))])
        w = _svm(np.concatenate([more, x[row[witness]], x[rows_clean]]), y, np.concatenate([more_weight, np.ones(len(witness)), clean_weight]))
        margin = (x @ w[:-1] + w[-1])[row]
    return Model(kernel, root, w[:-1], float(w[-1]) - _border(margin, doc_of, toxic))


def _border(margin: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> float:
    """Where clean and toxic training texts part with fewest errors; the middle of all such places."""
    at, _ = groups(doc)
    worst, own = np.maximum.reduceat(margin, at), toxic[doc[at]]
    cut = np.unique(worst)
    cut = np.concatenate([cut[:1] - 1, (cut[1:] + cut[:-1]) / 2, cut[-1:] + 1])
    t, f = np.sort(worst[own]), np.sort(worst[~own])
    loss = np.searchsorted(t, cut) + len(f) - np.searchsorted(f, cut)
    good = np.flatnonzero(loss == loss.min())
    return float(cut[good[len(good) // 2]])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", most: int = LEARN_DOCS) -> Model | None:
    """Train on up to about ``most`` labelled rows of each class, chosen by the hash of their id."""
    known = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("_lid")).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    part = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, most / n))])
    sample = known.filter(F.pmod(F.xxhash64("_lid"), F.lit(1 << 20)) < part[F.col("_toxic")] * (1 << 20))
    # The sample's size is bound by ``most``, so it can go to every task.
    got = docs.select(F.col(id_col).cast("long").alias("_did"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), F.col("_did") == F.col("_lid")).select("_did", "text", "_toxic").orderBy("_did").toArrow()
    return fit(got["text"].to_pylist(), got["_toxic"].to_numpy() > 0)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, worst) per row; ``worst`` is the window that weighs most in the worst sentence, null if none is near a landmark."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b, buf, at in blocks(batches, "text"):
            margin = np.full(b.num_rows, -20.0)
            worst: list[str | None] = [None] * b.num_rows
            if model is not None:
                got, doc, (sym, s, n, sentence, worth) = model.margins(buf, at)
                np.maximum.at(margin, doc, got)
                # The window that is worth most in the document's worst sentence.
                chosen = np.flatnonzero((got[sentence] == margin[doc[sentence]]) & (worth > 0))
                chosen = chosen[np.lexsort((-worth[chosen], doc[sentence[chosen]]))]
                for k in chosen[groups(doc[sentence[chosen]])[0]].tolist():
                    worst[doc[sentence[k]]] = "".join(chr(96 + c) if c < OTHER else "*" for c in sym[s[k] : s[k] + n[k]].tolist())
            yield pa.record_batch([b.column(0), pa.array(probability(margin)), pa.array(worst, pa.string())], names=["id", "score", "worst"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, worst string")
