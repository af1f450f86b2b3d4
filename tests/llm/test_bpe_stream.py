"""The transducer against the tokenizers library and against merging whole strings."""

import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vicinage.llm import bpe_stream as bs
from vicinage.llm import queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "a", "b", " ", "  ", "\n", "'", "'s", "'re", "'R", "<|endoftext|>", "<|endo", "<", "1", "２", "é", "😀", "՘", " ", "\u0085", "!", "\t", "the", "​", "ſ",
    " " * 300, "w" * 700, "-" * 600, "'" * 300, "　" * 400, "ab" * 500, "9" * 400, "՘" * 300, "neighbourhoods", "\x00",
]


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), bs.Vocabulary(PATH)


def test_fed_in_any_chunks_as_the_library_encodes_whole_texts(both):
    whole, v = both
    draw = random.Random(3)
    for _ in range(800):
        text = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14)))
        want = whole.encode(text, add_special_tokens=False).ids
        got = bs.encode_text(v, text, draw.choice([1, 2, 3, 7, 50, 257, 1000, bs.CHUNK]))
        assert got == want
        assert bs.decode_ids(v, got, draw.choice([1, 5, 1000])) == whole.decode(want, skip_special_tokens=False)


def test_any_ids_decode_as_in_the_library(both):
    whole, v = both
    draw = random.Random(4)
    for _ in range(300):
        ids = [draw.randrange(50257) for _ in range(30)]
        assert bs.decode_ids(v, ids, draw.choice([1, 3, 100])) == whole.decode(ids, skip_special_tokens=False)
    assert bs.decode_ids(v, [None, 64, 10**6, -1]) == "a"


def test_pretokens_merged_together_are_those_merged_alone(both):
    v = both[1]
    draw = random.Random(6)
    words = ["".join(draw.choice(PIECES[:28] + ["ing", "er", " ne", "aaa"]) for _ in range(draw.randint(1, 9))).encode() for _ in range(700)]
    assert v.merge.together(words) == [bs.packed(v.merge(w)) for w in words]
    assert v.merge.together([]) == [] and v.merge.together([b"a"]) == [bs.packed(v.merge(b"a"))]


def test_named_classes_split_as_the_properties_do(both):
    v = both[1]
    draw = random.Random(7)
    every = [chr(i) for i in range(1 << 16) if not 0xD800 <= i < 0xE000]
    draw.shuffle(every)
    for text in ("".join(every), " ".join(every), "'".join(every[:20_000]), "".join(draw.choice(PIECES[:29]) for _ in range(5000)).replace("😀", "")):
        assert v.plain_split.findall(text) == v.split.findall(text)
    assert v.splitter("a😀") is v.split and v.splitter("aé") is v.plain_split


def test_many_texts_with_an_empty_memory_equal_the_library(both, monkeypatch):
    whole, v = both
    draw = random.Random(9)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 14))) for _ in range(200)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for together, remembered, chunk in ((1 << 20, 10, bs.CHUNK), (1, 10**6, 3), (500, 100, 64)):
        monkeypatch.setattr(bs, "TOGETHER", together)
        monkeypatch.setattr(bs, "REMEMBERED", remembered)
        v.known.clear()
        assert [x.tolist() for x in bs.encode_texts(v, texts, chunk)] == want
    d = v.merge.together
    calls = []
    monkeypatch.setattr(bs, "TOGETHER", 1 << 20)
    monkeypatch.setattr(v.merge, "together", lambda raws: calls.append(len(raws)) or d(raws))
    v.known.clear()
    assert [x.tolist() for x in bs.encode_texts(v, texts)] == want and len(calls) == 1 and calls[0] > 100


def test_memory_does_not_grow_with_the_text(both):
    v = both[1]
    e, held, out = bs.Encoder(v), 0, []
    for k in range(60):
        out += e.feed("w" * 997 if k % 20 else " x")
        held = max(held, len(e.rest) + len(e.window))
    assert held < 2 * (v.lookahead + v.longest) + 3 * bs.LONG
    assert v.lookahead < 200


def _merged(text, merges):
    """Merging the whole string, rank by rank, from the left."""
    parts = list(text)
    for a, b in merges:
        i = 0
        while i + 1 < len(parts):
            if parts[i] == a and parts[i + 1] == b:
                parts[i : i + 2] = [a + b]
            i += 1
    return parts


@st.composite
def merge_lists(draw):
    parts, merges = ["a", "b", "c"], []
    for _ in range(draw(st.integers(1, 9))):
        pair = (draw(st.sampled_from(parts)), draw(st.sampled_from(parts)))
        if "".join(pair) not in parts:
            merges.append(pair)
            parts.append("".join(pair))
    return merges


@settings(max_examples=400, deadline=None)
@given(merge_lists(), st.text("abc", max_size=40), st.text("abc", max_size=12))
def test_tokens_before_the_lookahead_are_stable(merges, text, more):
    n = len(text) - bs.sufficient_lookahead(merges)
    stable, at = [], 0
    for part in _merged(text, merges):
        at += len(part)
        if at > n:
            break
        stable.append(part)
    assert _merged(text + more, merges)[: len(stable)] == stable


def test_a_shorter_lookahead_would_not_do():
    # "ab" takes b from "bc", which frees the c, and so on: each end changes the next token to the left.
    merges = [("c", "d"), ("b", "c"), ("a", "b")]
    assert bs.sufficient_lookahead(merges) == 3
    assert _merged("abc", merges)[0] == "a" and _merged("abcd", merges)[0] == "ab"


def test_lists_that_are_not_in_order_are_refused():
    for merges in ([("ab", "c")], [("a", "b"), ("a", "b")], [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")]):
        with pytest.raises(ValueError):
            bs.sufficient_lookahead(merges)


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bs.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    said = json.load(open(PATH))
    said["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(said))
    with pytest.raises(ValueError):
        bs.Vocabulary(str(tmp_path / "t.json"))


def test_odd_rows_and_empty_tables(spark, both):
    whole = both[0]
    rows = [(1, None, 5, "x"), (2, "", 5, "x"), (3, "one two", 5, "x"), (3, "one two", 5, "x"), (None, "w" * 70_000 + " <|endoftext|>", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, id long, ids string")
    got = sorted((str(r["id"]), r["ids"], r["text"]) for r in bs.decode(bs.encode(d, PATH), PATH).collect())
    assert got == sorted((str(i), whole.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows)
    assert bs.decode(bs.encode(d.limit(0), PATH), PATH).count() == 0


def test_query_equals_the_library(spark, sf_dir, both):
    import hashlib

    whole = both[0]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op13_bpe_stream(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = whole.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
