from __future__ import annotations

import random

import numpy as np
import pytest

from loomstead.llm import spans
from loomstead.llm.fmindex import SharedTextIndex, WaveletTree


def brute(rows, need):
    """Covered characters of each (doc_id, text) by windows that stand in a text of another doc_id."""
    owners: dict[str, set] = {}
    for d, t in rows:
        for i in range(len(t or "") - need + 1):
            owners.setdefault(t[i : i + need], set()).add(d)
    out = {}
    for d, t in rows:
        cover = set()
        for i in range(len(t or "") - need + 1):
            if len(owners[t[i : i + need]]) > 1:
                cover.update(range(i, i + need))
        if cover:
            out[d] = len(cover)
    return out


def mixed(rng, n, shared, alphabet):
    rows = []
    for d in range(n):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randrange(120)], "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))]
        rows.append((d, "".join(parts)))
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "漢字かなé🧵 xyz"])
@pytest.mark.parametrize("hot", [10_000, 3])
def test_like_brute_force(spark, alphabet, hot):
    rng = random.Random(len(alphabet) + hot)
    shared = ["".join(rng.choice(alphabet) for _ in range(150)) for _ in range(3)] + ["=" * 140]
    rows = mixed(rng, 60, shared, alphabet)
    rows += [(100, None), (101, ""), (102, "short"), (103, rows[0][1]), (104, "=" * 200), (None, rows[1][1])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, h int, first int")
    got = {r.doc_id: r.shared_chars for r in spans.shared_share(df, 40, gram=20, hot_contexts=hot).collect()}
    assert got == brute([r for r in rows if r[0] is not None], 40)


def test_copies_and_lone_documents(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(500))
    df = spark.createDataFrame([(1, text), (2, text), (3, text), (4, "z" + text[:198] + "z"), (5, text[100:300])], "doc_id long, text string")
    got = {r.doc_id: r.shared_chars for r in spans.shared_share(df).collect()}
    assert got == brute([tuple(r) for r in df.collect()], 200)
    assert spans.shared_share(df.where("doc_id = 1")).count() == 0 and spans.shared_share(df.limit(0)).count() == 0
    # The same text twice under one id is no other document.
    assert spans.shared_share(df.where("doc_id = 1").unionAll(df.where("doc_id = 1"))).count() == 0


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD_CHARS", 300)
    rng = random.Random(5)
    rows = mixed(rng, 40, ["".join(rng.choice("abcd ") for _ in range(150)) for _ in range(4)], "abcd ")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, 40, gram=20).collect()} == brute(rows, 40)


def test_rank():
    rng = np.random.default_rng(0)
    for kinds in (1, 2, 5, 300):
        s = rng.integers(0, kinds, 1000) if kinds > 1 else np.zeros(1000, np.int64)
        tree = WaveletTree(s, kinds)
        c, at = rng.integers(0, kinds, 200), rng.integers(0, 1001, 200)
        assert (tree.rank(c, at) == [(s[:a] == x).sum() for x, a in zip(c, at)]).all()


def test_matching_statistics():
    texts = ["xxabcdefyy", "abcdefzz", "zzabcde"]
    which, begin, end = SharedTextIndex(texts, np.array([1, 2, 3]), np.array([1, 2, 3])).spans(5)
    found = {(int(w), texts[w][b:e]) for w, b, e in zip(which, begin, end)}
    # Spans within longer ones may be given too.
    assert found - {(0, "abcde"), (1, "abcde")} == {(0, "abcdef"), (1, "abcdef"), (2, "abcde")}
    which, _, _ = SharedTextIndex(texts, np.array([1, 1, 1]), np.array([1, 1, 1])).spans(5)
    assert len(which) == 0
