"""Operators against brute force, SQL or held-out accuracy, and the cases that every operator defines."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vicinage.llm import decontaminate as dc
from vicinage.llm import language, packing, queries, toxicity, url_rules
from vicinage.llm.exact_dedup import build_mph, exact_dedup, find
from vicinage.llm.graph import components
from vicinage.llm.jaccard_join import jaccard_join
from vicinage.llm.line_dedup import line_dedup
from vicinage.llm.sharding import assign_shards, jump_hash
from vicinage.llm.suffix_dedup import suffix_dedup

DOCS = "doc_id long, text string, source string, lang string, id long, key long, text2 string"
P = "the quick brown fox jumps over a lazy dog while seven wizards box with gloves made of thin paper and glue "
ODD = [
    (1, None, None, None, 7, 7, "x"), (2, "", "a", "en", 7, 7, "x"), (3, P * 3, "a", "en", 7, 7, "x"), (4, P * 3, "b", None, 7, 7, "x"), (5, "x " + P + "y", "b", "en", None, 7, None),
    (6, "w" * 70_000, "c", "en", 7, 7, "x"), (7, "one", "c", "en", 7, 7, "x"), (8, "One", "c", "en", 7, 7, "x"), (9, "12 34 !?", "c", "en", 7, 7, "x"), (9, "12 34 !?", "c", "en", 7, 7, "x"), (None, "lost " + P, "d", "en", 7, 7, "x"),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def removed(rows):
    """Brute force of the suffix dedup over (id, text), ids distinct."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (d, docs(spark, [r for r in ODD if r[0] != 9])):
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(df).collect()}
        assert got == removed([(r["doc_id"], r["text"]) for r in df.collect()])
    assert suffix_dedup(docs(spark)).count() == len(ODD)


def test_refinement_splits_buckets_by_their_members_pointers():
    from vicinage.llm.suffix_dedup import refine, refine_round

    # "ab" at 0, 3 and 6 is one bucket; what stands at offset 2 is in the buckets of "c", "d" and "c".
    text = b"abcabdabc"
    order = sorted(range(9), key=lambda i: text[i : i + 1] if i in (2, 5, 8) else text[i : i + 2])
    first = {i: min(k for k, j in enumerate(order) if text[j : j + (1 if i in (2, 5, 8) else 2)] == text[i : i + (1 if i in (2, 5, 8) else 2)]) for i in range(9)}
    pointer = np.array([first[i] for i in range(9)], np.uint32)
    assert pointer[0] == pointer[3] == pointer[6]
    before = pointer.copy()
    open_ = refine_round(pointer, np.array([0, 3, 6]), 2)
    assert pointer[0] == pointer[6] == before[0] != pointer[3] and sorted(open_.tolist()) == [0, 6]
    rng = np.random.default_rng(1)
    for length in (5, 8, 20, 100):
        buf = rng.integers(97, 99, 2000).astype(np.uint8)
        buf[1000:1900] = buf[50:950]
        at = np.sort(rng.choice(2000 - length, 700, replace=False))
        seen = defaultdict(set)
        for x, v in zip(at.tolist(), refine(buf, at, length).tolist(), strict=True):
            seen[buf[x : x + length].tobytes()].add(v)
        assert all(len(v) == 1 for v in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_suffix_dedup_of_hot_anchors(spark, sf_dir, monkeypatch):
    from vicinage.llm import suffix_dedup as sd

    for name, value in (("HOT", 2), ("REFINE_BYTES", 3000), ("SEND_BYTES", 20_000)):
        monkeypatch.setattr(sd, name, value)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(4)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup(d).collect()}
    assert got == removed([(r["doc_id"], r["text"]) for r in d.collect()])


def thue_morse(levels):
    x, y = "a", "b"
    for _ in range(levels):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("levels", [10, 12])
def test_repetitive_words_do_not_collide(spark, levels):
    x, y = thue_morse(levels)
    texts = [x, y, f"one {x} two three", f"one {y} two three", f"one {x} two three"]
    rows = [(i, t, "s", "en", 7, 7, "x") for i, t in enumerate(texts)]
    got = {r["id"]: r["component_id"] for r in jaccard_join(docs(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    ids = [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for r in packing.pack(docs(spark, rows), path).collect():
        part = np.array(ids[r["id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(ids[r["id"]]) and zlib.crc32(part.tobytes()) == r["ids_crc32"]


def linked(rows, width, percent):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(lower))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find_(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d in sorted(sets, key=lambda k: len(sets[k])):
        both = defaultdict(int)
        for g in sets[d]:
            for o in where[g]:
                both[o] += 1
            where[g].append(d)
        for o, n in both.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = find_(d), find_(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find_(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, width, percent):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        base = [f"w{k}" for k in rng.integers(0, 60, 30 + 40 * g)]
        for _ in range(8):
            own = list(base)
            for k in rng.integers(0, len(own), rng.integers(0, 6)):
                own[k] = f"v{rng.integers(0, 9)}"
            rows.append(" ".join(own))
    rows = [(i, t, "s", "en", 7, 7, "x") for i, t in enumerate(rows + [None, "", "a", "A", "a b c"])]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(docs(spark, rows), percent, width).collect()}
    assert got == linked([(r[0], r[1]) for r in rows], width, percent)


def test_jaccard_join_counts_every_link(spark, monkeypatch):
    from vicinage.llm import jaccard_join as jj

    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join(base)] * 2 + ["alone among all of these texts"]
    for k in range(60):
        own = list(base)
        for at in rng.integers(0, 120, 1 + k % 4):
            own[at] = f"v{k}"
        texts.append(" ".join(own))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    different = set(map(frozenset, sets))
    want = {i: sum(x != y and 100 * len(x & y) >= 85 * len(x | y) for y in different) for i, x in enumerate(sets)}
    rows = [(i, t, "s", "en", 7, 7, "x") for i, t in enumerate(texts)]
    assert want[0] > 30 and want[2] == 0
    for block in (jj.BLOCK, 7):
        monkeypatch.setattr(jj, "BLOCK", block)
        got = {r["id"]: (r["n_links"], r["equal_sets"]) for r in jaccard_join(docs(spark, rows)).collect()}
        assert got == {i: (n, 2 if i < 2 else 1) for i, n in want.items()}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 40), (40, 41), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 100: 40}


def test_masks_hit_every_window():
    from itertools import combinations
    from math import ceil

    for m in range(dc.SHORTEST, 14):
        masks = dc.MASKS[m >= dc.LONG]
        for bad in combinations(range(m), m - ceil(dc.SIMILARITY * m)):
            assert any(not {o + i for i in mask} & set(bad) for mask in masks for o in range(m - mask[-1]))


def test_decontamination_against_brute_force(spark, sf_dir):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    swapped = item.replace("gamma", "GAMMO").replace("kappa", "other")
    rows = [(1, f"before {item.upper()} after"), (2, f"so, {swapped}!"), (3, "alpha beta gamma delta unrelated words follow here and no more of it"), (4, None), (5, "short one"), (6, item[: len(item) // 2])]
    bench = spark.createDataFrame([(9, item, 1), (10, None, 1), (11, "short one", 1)], "item_id long, text string, doc_id long")
    full = docs(spark, [(*r, "s", "en", 7, 7, "x") for r in rows])
    got = {(r["id"], r["item"]): r["matches"] for r in dc.overlaps(full, bench).collect()}
    assert got == {(1, 9): 16, (2, 9): 14, (5, 11): 2}
    assert {r["doc_id"] for r in dc.decontaminate(full, bench).collect()} == {3, 4, 6}
    assert dc.overlaps(full, bench.limit(0)).count() == 0
    words = lambda t: re.findall(r"[a-z0-9\u0080-￿]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        t = f" {' '.join(words(r['text']))} "
        want |= {(r["doc_id"], k) for k, w in items.items() if f" {' '.join(w)} " in t}
    found = {(r["doc_id"], r["item_id"]) for r in queries.op2_benchmark_decontamination(spark, sf_dir).collect()}
    assert want and want <= found
    # Substitution-tolerant overlaps by brute force over all diagonals.
    whole = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        t = words(r["text"])
        for k, item in items.items():
            w, best = min(dc.WINDOW, len(item)), 0
            for diagonal in range(w - len(item), len(t) - w + 1) if set(t) & set(item) else ():
                lo, hi = max(0, diagonal), min(len(t), diagonal + len(item))
                same = np.array([a == b for a, b in zip(t[lo:hi], item[lo - diagonal : hi - diagonal], strict=True)])
                if same.sum() < 0.8 * w:
                    continue
                good = [i for i in range(hi - lo - w + 1) if same[i : i + w].sum() >= 0.8 * w - 1e-9]
                best = max(best, sum(bool(same[i]) for i in {i + j for i in good for j in range(w)}))
            if best:
                whole[r["doc_id"], k] = best
    assert {(r["doc_id"], r["item_id"]): r["matches"] for r in queries.op2_benchmark_decontamination(spark, sf_dir).collect()} == whole


def test_short_items_and_unspaced_scripts(spark):
    rows = [(1, "a short one inside"), (2, "first\nShort one!\nlast"), (3, "\u6211\u4eec\u4eca\u5929\u53bb\u5317\u4eac\u5927\u5b66\u770b\u4e66"), (None, "short one"), (5, "short one")]
    bench = spark.createDataFrame([(11, "short one"), (12, "\u4eca\u5929\u53bb\u5317\u4eac\u5927\u5b66")], "item_id long, text string")
    d = docs(spark, [(*r, "s", "en", 7, 7, "x") for r in rows])
    got = {(r["id"], r["item"], r["start"], r["matches"]) for r in dc.overlaps(d, bench).collect()}
    assert got == {(2, 11, 1, 2), (None, 11, 0, 2), (5, 11, 0, 2), (3, 12, 2, 7)}
    clash = d.withColumnRenamed("key", "leak").withColumnRenamed("text2", "KEY")
    assert [r["doc_id"] for r in dc.decontaminate(clash, bench).collect()] == [1] and dc.decontaminate(clash, bench).columns == clash.columns


def test_packing_round_trip(spark, sf_dir):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = docs(spark, [(20, "Don't  STOP… it's <|endoftext|> <|ENDOFTEXT|> naïve É.x é!! 3.14a", "s", "en", 7, 7, "x"), *[r for r in ODD if r[0] not in (9, None)]])
    for d in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd):
        ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in d.collect()}
        seen = {k: np.zeros(len(v), int) for k, v in ids.items()}
        rows = packing.pack(d, path).collect()
        sequences = defaultdict(list)
        for r in rows:
            part = ids[r["id"]][r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["id"]])
            seen[r["id"]][r["start"] : r["start"] + r["length"]] += 1
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert all((x == 1).all() for x in seen.values())
        for parts in sequences.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end == 2048 or end & (end - 1) == 0
    assert packing.pack(docs(spark, []), path).count() == 0


def test_least_squares_fills_windows():
    h = np.zeros(2048, np.int64)
    h[[1000, 1048, 500, 524]] = [30, 20, 10, 7]
    combos = packing.combinations(h)
    assert sorted(combos.tolist()) == [[0, 1000, 1048], [500, 500, 1048], [524, 524, 1000]]
    counts, left = packing.round_counts(h, combos, packing.solve(h, combos))
    used = np.bincount(combos.ravel(), np.repeat(counts, 3), minlength=2048)
    assert (counts >= 0).all() and left.min() >= 0 and (used[1:] + left[1:] == h[1:]).all()
    rng = np.random.default_rng(3)
    h = np.bincount(np.exp(rng.normal(6.3, 1, 10_000)).astype(int) % 2048, minlength=2048)
    h[0] = 0
    plan = packing.Plan(h, 0)
    assert plan.solved >= 0.85 * h.sum() and plan.cut <= 0.02 * h.sum()
    left = np.zeros(2048, np.int64)
    left[[512, 300, 724]] = [9, 3, 1]
    assert packing.fill_whole(left) and left.min() >= 0


def test_packing_fills_with_very_short_rests():
    for longest in (1, 40, 2000):
        left = np.zeros(2048, np.int64)
        left[1], left[longest] = 5000, 2 + 4998 * (longest == 1)
        before = left.sum()
        got = packing.fill_whole(left)
        assert got and all(sum(c) == 2048 for c, _ in got) and left.sum() == before - sum(len(c) * k for c, k in got)
        assert left.min() >= 0 and left @ np.arange(2048) < 2048


def test_exact_dedup(spark):
    digest = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(700)), np.uint8).reshape(-1, 32)
    seeds, slots = build_mph(digest)
    assert sorted(slots.tolist()) == list(range(700)) and (find(seeds, 700, digest) == slots).all()
    got = sorted(((r["id"], r["keep"], r["size"]) for r in exact_dedup(docs(spark)).collect()), key=str)
    assert got == sorted([(1, 2, 2), (2, 2, 2), (3, 4, 2), (4, 4, 2), (5, 5, 1), (6, 6, 1), (7, 8, 2), (8, 8, 2), (9, 9, 2), (9, 9, 2), (None, None, 1)], key=str)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_sharding(spark):
    keys = np.arange(20_000, dtype=np.uint64)
    a, b = jump_hash(keys, 8), jump_hash(keys, 9)
    assert set(b[a != b].tolist()) == {8} and abs((a != b).mean() - 1 / 9) < 0.01 and np.bincount(a).min() > 2300
    rows = assign_shards(docs(spark), 3).collect()
    assert len(rows) == len(ODD)
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_line_dedup(spark):
    boiler = "accept all cookies"
    rows = [(i, f"own line {i}\n{boiler}\n\n{'few sites' if i < 5 else 'x%d' % i}", f"site{i}", "en", 7, 7, "x") for i in range(15)] + [(50, None, "s", "en", 7, 7, "x"), (51, "", "s", "en", 7, 7, "x")]
    got = {r["doc_id"]: r for r in line_dedup(docs(spark, rows)).collect()}
    assert boiler in got[0]["text"] and all(boiler not in got[i]["text"] for i in range(1, 15))
    assert all(f"own line {i}" in got[i]["text"] for i in range(15)) and "few sites" in got[4]["text"]
    assert got[50]["text"] is None and got[51]["text"] == "" and got[3]["n_removed"] == 1
    assert line_dedup(docs(spark, [])).count() == 0 and line_dedup(docs(spark)).count() == len(ODD)
    extra = docs(spark, rows).selectExpr("*", "7 as _id", "8 as lines", "9 as n_lines", "10 as _th")
    out = line_dedup(extra)
    assert out.columns == [*extra.columns, "_n_lines", "n_removed"]
    r = out.filter("doc_id = 3").first()
    assert (r["_id"], r["lines"], r["n_lines"], r["_th"], r["_n_lines"], r["n_removed"]) == (7, 8, 9, 10, 4, 1)


def test_url_rules(spark):
    rows = [(1, "https://A.Example.ORG/es/1?q#f"), (2, "http://x.org"), (3, "http://x.org/p"), (4, "https://b.com/fr/2"), (5, "https://b.com/de/2"), (6, None), (7, "no scheme"), (8, "https://example.org/en/12"), (8, "https://example.org/en/12"), (9, "http://c.net/bad/1")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://c{i % 7}.net/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(60)], "url string, y int")
    rules, fallback = url_rules.mine(labelled, "url", F.col("y") == 1)
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules, fallback).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][1:3] == ("", None) and got[3] == ("x.org", "/p", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block") and got[6][:2] == ("", "") == got[7][:2]
    assert got[8][2:] == ("example.org/en/1", "block") and got[9][2:] == (None, "block")
    none, allow = url_rules.mine(labelled.limit(0), "url", F.col("y") == 1)
    assert url_rules.judge(pages, none, allow).count() == len(rows)


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(9)
    urls = [(f"http://{rng.choice(['a', 'b', 'c'])}.net/{rng.choice(['x', 'y'])}/{i}", None) for i in range(400)]
    rows = [(u, int(rng.random() < (0.6 if "b.net/x" in u else 0.1))) for u, _ in urls] + [(None, 1), ("http://a.net/x/1", None)]
    df = spark.createDataFrame(rows, "url string, y int")
    rules, _ = url_rules.mine(df, "url", F.col("y") == 1)
    got = {(tuple(r["antecedent"]), r["verdict"]): round(r["confidence"], 9) for r in rules.collect()}
    sets = [(frozenset(r["t"]), r["y"]) for r in df.filter("y is not null").select(url_rules.tokens(F.col("url")).alias("t"), "y").collect()]
    base, want = sum(y for _, y in sets) / len(sets), {}
    for size in range(1, 8):
        for t in {c for s, _ in sets for c in combinations(sorted(s), size)}:
            ys = [y for s, y in sets if set(t) <= s]
            if max(sum(ys), len(ys) - sum(ys)) < url_rules.MIN_COUNT:
                continue
            p = sum(ys) / len(ys)
            odds = (p / base) / (p / base + (1 - p) / (1 - base))
            if abs(p - base) / (base * (1 - base) / len(ys)) ** 0.5 >= url_rules.MIN_ERRORS and max(odds, 1 - odds) >= url_rules.MIN_CONFIDENCE:
                want[t, "block" if p > base else "allow"] = round(max(odds, 1 - odds), 9)
    want = {(t, v): c for (t, v), c in want.items() if not any(v == w and set(u) < set(t) and d >= c for (u, w), d in want.items())}
    assert want and got == want


def test_host_path_and_rule_equal_sql(duck, spark, sf_dir):
    got = {(r["page_id"], r["host"], r["path"], r["rule"]) for r in queries.op7_url_rules(spark, sf_dir).collect()}
    fits = " ".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '/{t}') THEN '{r}'" for r, n, t in sorted(((r, r.partition("/")[0], r.partition("/")[2]) for r, _ in url_rules.RULES), key=lambda x: -len(x[0]))
    )
    sql = f"""WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
    SELECT page_id, coalesce(host, ''), coalesce(path, ''), CASE {fits} END FROM h"""
    assert got == set(duck.sql(sql).fetchall())


def _toxic_score(model, t):
    import pyarrow as pa

    m, _, _ = model.margins(*toxicity.as_bytes(pa.array([t])))
    return float(toxicity.probability(m.max(initial=-20)))


def test_toxicity_bears_insertions():
    rng = np.random.default_rng(5)
    clean = lambda: " ".join("".join(rng.choice(list("aehinorst"), 5)) for _ in range(12))
    texts, toxic = [], []
    for i in range(300):
        t = clean()
        texts.append(t if i % 3 else t.replace(t.split()[4], ["blockhead", "numpty", "villain"][i % 9 // 3]))
        toxic.append(i % 3 == 0)
    model = toxicity.fit(texts, np.array(toxic))
    assert np.mean([_toxic_score(model, clean()) >= 0.7 for _ in range(100)]) < 0.05
    words = ("blockhead", "block-head", "n u m p t y", "num pty", "vill ain", "bl0ckhead", "blockkhead", "numppty", "villlain")
    assert all(_toxic_score(model, f"{clean()} {w} {clean()}") >= 0.7 for w in words)
    assert toxicity.fit([], np.zeros(0)) is None and toxicity.fit(["a"], np.ones(1)) is None


def test_toxicity_reads_other_scripts():
    rng = np.random.default_rng(3)
    vocab = ["\u0434\u043e\u0431\u0440\u044b\u0439", "\u0434\u0435\u043d\u044c", "\u043f\u043e\u0433\u043e\u0434\u0430", "\u043a\u043d\u0438\u0433\u0430", "\u0433\u043e\u0440\u043e\u0434", "\u0432\u0435\u0447\u0435\u0440"]
    bad = "\u0434\u0443\u0440\u0430\u043a"
    text = lambda k: " ".join([*rng.choice(vocab, 4), *[bad] * (k % 2), *rng.choice(vocab, 3)])
    model = toxicity.fit([text(k) for k in range(300)], np.arange(300) % 2 == 1)
    assert _toxic_score(model, f"{vocab[4]} {bad} {vocab[3]}") >= 0.7 > _toxic_score(model, " ".join(vocab))


def test_kernel_equals_brute_force():
    import pyarrow as pa
    from itertools import combinations

    def phi(t):
        out = defaultdict(float)
        for i in combinations(range(len(t)), 3):
            if i[2] - i[0] < toxicity.SPAN:
                out["".join(t[j] for j in i)] += toxicity.DECAY ** (i[2] - i[0] - 2)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    strings = ["idiot", "idioot", "banana", "nanana", "trash", "thrash"]
    sym, s, e, _, _ = toxicity.sentences(*toxicity.as_bytes(pa.array([" ".join(strings)])))
    got = toxicity.Kernel(sym, s, e - s).strings(sym, s, e - s)
    for i, x in enumerate(strings):
        for j, y in enumerate(strings):
            k = sum(v * phi(y).get(u, 0) for u, v in phi(x).items())
            assert abs(got[i, j] - max(0, (k - toxicity.FLOOR) / (1 - toxicity.FLOOR)) ** 2) < 1e-4


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test data")
    got = queries.op8_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    right, all_clean = n[0, 0] + n[1, 1], n[0, 0] + n.get((0, 1), 0)
    assert right >= all_clean + 0.03 * sum(n.values()) and n[1, 1] >= 0.6 * (n[1, 1] + n[1, 0])


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test data")
    x = queries.op10_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert x.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_sets_are_whole(spark):
    rng = np.random.default_rng(7)
    own = {"a": "abcdef", "b": "ghijkl", "c": "mnopqr", "d": "stuvwx"}
    text = lambda lang, n: " ".join("".join(rng.choice(list(own[lang]), 5)) for _ in range(n))
    labelled = [(k, text(lang, 400), "s", lang, 7, 7, "x") for k, lang in enumerate(own)]
    model = language.learn(docs(spark, labelled))
    mixed = [(1, f"{text('a', 20_000)} {text('b', 300)}"), (2, " ".join(text(x, 100) for x in "abcd")), (3, text("c", 500))]
    got = {r["id"]: r for r in language.identify(docs(spark, [(*r, "s", None, 7, 7, "x") for r in mixed]), model).collect()}
    assert got[1]["langs"] == ["a", "b"] and abs(got[1]["proportions"][1] - 300 / 20_300) < 0.002
    assert set(got[2]["langs"]) == set(own) and np.allclose(got[2]["proportions"], 0.25, atol=0.02)
    assert got[3]["langs"] == ["c"]


def test_odd_texts_are_scored(spark):
    none = language.identify(docs(spark), None)
    assert {r["lang_pred"] for r in none.collect()} == {language.UNKNOWN} and language.learn(docs(spark, [])) is None
    model = language.learn(docs(spark))
    got = {r["id"]: r["lang_pred"] for r in language.identify(docs(spark), model).collect()}
    assert got[1] == got[2] == got[9] == language.UNKNOWN and got[3] == "en"
    assert toxicity.score(docs(spark), None).filter("score < 0.7").count() == len(ODD)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_on_empty_tables(name, spark, sf_dir, tmp_path):
    if name == "op4_packing":
        pytest.importorskip("public_tokenizers")
    for table in ("documents", "benchmark", "pages", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    pytest.importorskip("public_tokenizers")
    assert len(corpus_pipeline.STAGES) == 5
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [first]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.materialize(stage(spark, tables[-1], sf_dir), "test"))
    rows = [[(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()] for t in tables[:5]]
    assert {d for d, _ in rows[1]} == {d for d, t in rows[0] if any(c.isalpha() for c in t or "")}
    assert {d for d, _ in rows[2]} == {d for d, _ in rows[1]}
    components = linked(rows[2], 5, 80)
    assert {d for d, _ in rows[3]} == {d for d, _ in rows[2] if components[d][1] == d}
    items = [re.findall(r"[a-z0-9\u0080-\uffff]+", r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, t in rows[3] if any(f" {' '.join(i)} " in f" {' '.join(re.findall(r'[a-z0-9\u0080-\uffff]+', t.lower()))} " for i in items)}
    assert leaked <= {d for d, _ in rows[3]} - {d for d, _ in rows[4]} and len(rows[4]) > 0.8 * len(rows[0])
    packed = tables[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r["doc_id"] for r in packed} == {d for d, _ in rows[4]} and all(r["n"] == r["all"] for r in packed)
