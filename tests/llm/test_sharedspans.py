import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import sharedspans
from folioscope.llm.fmindex import FMIndex, WaveletMatrix
from tests.conftest import rows

SCHEMA = "page_id long, blocks array<struct<id:string,text:string>>, ingested_at timestamp, window string, fp int"


def codes(s):
    return sharedspans.code_points(s)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=30), min_size=1, max_size=8), st.text(alphabet="abéz", min_size=1, max_size=8))
def test_backward_search_counts_and_locates(texts, pattern):
    fm = FMIndex([codes(t) for t in texts], 16)
    lo, hi, matched = fm.search(np.stack([codes(pattern)]))
    want = sorted((i, k) for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(pattern, k))
    longest = max(n for n in range(len(pattern) + 1) if n == 0 or any(pattern[-n:] in t for t in texts))
    assert matched[0] == longest
    if longest == len(pattern):
        text, at = fm.locate(int(lo[0]), int(hi[0]))
        assert sorted(zip(text.tolist(), at.tolist(), strict=True)) == want


def test_rank():
    seq = np.random.default_rng(1).integers(0, 11, 1000)
    w = WaveletMatrix(seq, 11)
    at = np.arange(0, 1001, 7)
    for c in range(11):
        assert w.rank(np.full(len(at), c), at).tolist() == [int((seq[:i] == c).sum()) for i in at]


def test_common_spans_have_a_common_fingerprint():
    rng = random.Random(4)
    for _ in range(40):
        span = "".join(rng.choice("abcdef ") for _ in range(120))
        one, two = ("".join(rng.choice("abcdef ") for _ in range(rng.randrange(150))) + span + "".join(rng.choice("abcdef ") for _ in range(rng.randrange(150))) for _ in range(2))
        assert set(sharedspans.fingerprints(codes(one))[0].tolist()) & set(sharedspans.fingerprints(codes(two))[0].tolist())


def test_every_window_keeps_a_minimum_where_hashes_repeat():
    rng = random.Random(8)
    for text in ("a" * 400, "ab" * 300, "abcde" * 100, "".join(rng.choice("ab") for _ in range(50)) * 9, "x" + "a" * 90 + "y" * 200):
        h, at = sharedspans.fingerprints(codes(text), 24, 8)
        grams = [text[i : i + 8] for i in range(len(text) - 7)]
        by = {}
        for i, g in enumerate(grams):
            by.setdefault(g, i)
        kept = set(at.tolist())
        assert all(any(i + k in kept for k in range(17)) for i in range(len(grams) - 16))
        assert len(at) < 4 * len(text) / 17 + 40


def brute(pages, span=120):
    seen = {}
    for p, blocks in pages.items():
        for t in blocks:
            for i in range(len(t or "") - span + 1):
                seen.setdefault(t[i : i + span], set()).add(p)
    return sorted({(a, b) for s in seen.values() for a in s for b in s if a < b}, key=repr), seen


def corpus(rng, n=40):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = ["boiler plate " + text(60), text(22)[:119], text(30)[:120], text(30)[:121], "é日" * 70]
    pages = {}
    for p in range(1, n + 1):
        blocks = [text(rng.randrange(5, 80)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            b = rng.randrange(3)
            x = rng.choice(passages)
            cut = rng.randrange(0, max(1, len(x) - 125)) if rng.random() < 0.4 else 0
            blocks[b] = text(rng.randrange(9)) + "#" + x[cut:] + "#" + text(rng.randrange(9))
        pages[p] = blocks
    return pages


def frame(spark, pages):
    return spark.createDataFrame([(p, [("i", t) for t in b], datetime(2026, 1, 1), "clash", 3) for p, b in pages.items()], SCHEMA)


@pytest.mark.parametrize("hot", [1500, 3])
def test_same_pairs_as_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sharedspans, "HOT", hot)
    pages = corpus(random.Random(hot))
    want, seen = brute(pages)
    df = frame(spark, pages)
    assert rows(sharedspans.found(df.unionByName(df))) == want
    share = {r.page_id: r.shared_chars for r in sharedspans.shared_amounts(df).collect()}
    for p, blocks in pages.items():
        covered = 0
        for t in blocks:
            mark = [False] * len(t)
            for i in range(len(t) - 119):
                if len(seen[t[i : i + 120]]) > 1:
                    mark[i : i + 120] = [True] * 120
            covered += sum(mark)
        assert share[p] == covered


def test_odd_rows(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    df = spark.createDataFrame([(1, None, None, "", 0), (2, [], None, "", 0), (3, [None, ("i", None), ("i", ""), ("i", "short")], None, "", 0), (4, [("i", long), ("i", long)], None, "", 0), (5, [("i", "x" + long[777:1000])], None, "", 0), (6, [("i", "a" * 500)], None, "", 0), (7, [("i", "a" * 130)], None, "", 0)], SCHEMA)
    assert rows(sharedspans.found(df)) == [(4, 5), (6, 7)]
    assert rows(sharedspans.shared_amounts(df), "page_id", "shared_chars") == [(1, 0), (2, 0), (3, 0), (4, 446), (5, 223), (6, 500), (7, 130)]
    assert sharedspans.found(df.where("false")).count() == 0


def test_a_hot_fingerprint_in_bounded_memory():
    rng = random.Random(5)
    text = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    gram, sides = text(64), [text(56) for _ in range(3)]
    windows = [text(56 - k) + rng.choice(sides)[56 - k :] + gram + text(56) for k in rng.choices(range(57), k=20_000)]
    rows_ = [(1, 0, 7, i, w, i < 50) for i, w in enumerate(windows)]
    import tracemalloc

    batch = sharedspans.pa.RecordBatch.from_pylist([dict(zip(("shard", "salt", "fp", "wid", "window", "is_index"), r, strict=True)) for r in rows_])
    tracemalloc.start()
    got = {(r["wid"], r["partner"]) for out in sharedspans._search(iter([batch])) for r in out.to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=True)) if p != q), 56)
    want = {(i, j) for i, w in enumerate(windows) for j, v in enumerate(windows[:50]) if i != j and w[26:56] == v[26:56] and common(w[55::-1], v[55::-1]) + common(w[120:], v[120:]) >= 56}
    assert got == want and want and peak < 200e6


def test_anchors_meet_wherever_a_span_is_shared(spark):
    rng = random.Random(6)
    pair = []
    for k in range(300):
        alphabet = "a" if k % 3 == 0 else "ab" if k % 3 == 1 else "abcdefgh "
        span = "".join(rng.choice(alphabet) for _ in range(120))
        for _ in range(2):
            left, right = ("".join(rng.choice("xyz") for _ in range(56)) for _ in range(2))
            at = rng.choice([i for i in range(57) if span[i : i + 64] == span[20:84]])
            pair.append((k, (left + span + right)[at : at + 176], 56))
    got = spark.createDataFrame(pair, "k int, window string, rel int").withColumn("a", sharedspans.anchors()).groupBy("k").agg(sharedspans.F.collect_list("a").alias("a")).collect()
    assert len(got) == 300 and all(set(r.a[0]) & set(r.a[1]) for r in got)
