"""Alignment against byte offsets, plain pair loops and a plain union-find."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from vicinage.llm import alignment as al
from vicinage.llm import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return al.ByteTokenizer(A), al.PieceTokenizer(B)


def plain(texts, a, b):
    """Per text what the contract asks for, from offsets and loops."""
    out, links = [], []
    for t in texts:
        whole = (" " + t).encode() if t else b""
        ids = [side([t])[0] if t else [] for side in (a, b)]
        if any(b"".join(side.raw[x] for x in i) != whole for side, i in zip((a, b), ids, strict=True)):
            ids = [[], []]
        spans = []
        for side, i in zip((a, b), ids, strict=True):
            ends = np.cumsum([len(side.raw[x]) for x in i]).tolist()
            spans.append(list(zip(i, [0, *ends[:-1]], ends, strict=True)) if i else [])
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        grouped, start = [], 0
        for cut in cuts:
            grouped.append("|".join(",".join(str(x) for x, s, e in side if start <= s and e <= cut) for side in spans))
            start = cut
        own = [(x, y) for x, s, e in spans[0] for y, s2, e2 in spans[1] if s < e2 and s2 < e]
        links.append(own)
        out.append([len(ids[0]), len(ids[1]), len(cuts), len(own), hashlib.sha256(";".join(grouped).encode()).hexdigest() if cuts else ""])
    counts = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(*o[:4], sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), o[4]) for o, own in zip(out, links, strict=True)], counts, most


ODD = [
    None, "", " ", "one two", "one two", "a▁b", "<|endoftext|> <s></s>", "naïve 😀 z\x00 x ﬁ", "\n\n  \t", "w" * 3000, "日本語のテキスト 12,345.67", "über-neighbourhoods' 're",
    "x" + "́" * 40, "ab" * 700,
]


def rows_of(got):
    return sorted((str(r["id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got.collect())


@pytest.mark.parametrize("block", [1, 200, 1 << 21])
def test_odd_texts_equal_plain_loops_whatever_the_blocks(spark, sides, block, monkeypatch):
    monkeypatch.setattr(al, "BLOCK", block)
    ids = [None if i == 3 else i % 12 for i in range(len(ODD))]
    d = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in zip(ids, ODD, strict=True)], "doc_id long, text string, id long, pair string, block int")
    got, pairs = al.align(d, A, B)
    want, counts, most = plain(ODD, *sides)
    assert rows_of(got) == sorted((str(i), *w) for i, w in zip(ids, want, strict=True))
    assert {(r["a"], r["b"]): (r["total"], r["best"]) for r in pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in counts.items()}


def test_union_find_equals_a_plain_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(0, 300))
        step = rng.integers(0, 3, n)  # the next link shares the A token, the B token or neither
        a, b = np.cumsum(step != 0), np.cumsum(step != 1)
        root = list(range(n))
        for i in range(1, n):
            if a[i] == a[i - 1] or b[i] == b[i - 1]:
                root[i] = root[i - 1]
        assert al.unite(a, b).tolist() == root


def test_empty_table(spark):
    got, pairs = al.align(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.count() == 0 and pairs.count() == 0


def test_query_equals_plain_loops(spark, sf_dir, sides):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    short = [(i, t) for i, t in texts if t is None or len(t) < 4000]
    d = spark.createDataFrame(short, "doc_id long, text string")
    want, *_ = plain([t for _, t in short], *sides)
    assert rows_of(al.align(d, A, B)[0]) == sorted((str(i), *w) for (i, _), w in zip(short, want, strict=True))
    got = queries.op11_token_alignment(spark, sf_dir)
    assert got.count() == len(texts) and got.filter("n_best > n_links OR n_groups > n_a").count() == 0
