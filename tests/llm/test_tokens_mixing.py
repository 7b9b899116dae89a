from __future__ import annotations

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstead.llm import mixing
from loomstead.llm.bpe import PIECES, encoder, vocabulary_path
from loomstead.llm.tokens import cut_long, encode_column

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def coders():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return encoder(vocabulary_path("byte_bpe_50k")), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern():
    assert PIECES == P.PATTERN


PARTS = st.sampled_from(["'s", "'ll", "'", " ", "  ", "\n", "\t", "a", "the", " lease", "12", "9876543", "é", "漢字かな", "🧵", "½", "\x1c", "\x85", "　", "\xa0", "<|endoftext|>", "_-", "x" * 40])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=30).map("".join), max_size=6))
def test_same_as_the_merges(coders, texts):
    own, other = coders
    flat, ends = own.encode_batch(texts)
    got = [flat[a:b].tolist() for a, b in zip([0, *ends], ends)]
    assert got == [other.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_any_text(coders, text):
    assert coders[0].encode(text) == coders[1].encode_ordinary(text)
    assert coders[1].decode(coders[0].encode(text)) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, max_size=120).map("".join), st.integers(3, 40))
def test_cut_anywhere_allowed(coders, text, most):
    parts = cut_long(text, most)
    assert "".join(parts) == text
    assert sum((coders[0].encode(p) for p in parts), []) == coders[0].encode(text)


def test_column(spark, coders):
    long = "word and more " * 120_000
    rows = [(1, "hello world", 7), (2, "", 8), (3, None, 9), (4, " ", None), (5, long, 1), (1, "hello world", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encode_column(df).orderBy("doc_id").collect()]
    encode = coders[1].encode_ordinary
    assert got == [(1, encode("hello world")), (1, encode("hello world")), (2, []), (3, None), (4, encode(" ")), (5, encode(long))]
    assert encode_column(df.limit(0)).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2000, 5000)
    p = np.full(5000, 0.3)
    q = mixing.flight(sizes, p, np.random.default_rng(2))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert np.isclose(q.sum(), p.sum()) and np.isclose(q @ sizes, p @ sizes)
    same = mixing.flight(np.full(50, 7), np.full(50, 0.5), np.random.default_rng(3))
    assert ((same > 0) & (same < 1)).sum() <= 2 and np.isclose(same.sum(), 25)
    landed = mixing.land(sizes, q, np.random.default_rng(4))
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed @ sizes - p @ sizes) <= 2 * sizes.max()


def test_flight_has_no_drift():
    sizes = np.arange(1, 13)
    hits = sum((mixing.land(sizes, mixing.flight(sizes, np.full(12, 0.25), np.random.default_rng(i)), np.random.default_rng(-i % 977)) for i in range(1500)), np.zeros(12))
    assert np.abs(hits / 1500 - 0.25).max() < 0.08


def test_mix(spark):
    from pyspark.sql import Row

    docs = [(i, "word " * (1 + i % 50), "big") for i in range(600)] + [(1000 + i, "word " * 10, "small") for i in range(10)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = [("m", 0.2, "big", 0.7, 2), ("m", 0.2, "small", 0.2, 3), ("m", 0.2, "absent", 0.1, 3), ("m", 0.2, "big", 0.7, 2), ("none", None, "big", 0.5, 1), (None, 0.1, "big", 0.1, 1)]
    targets = spark.createDataFrame(rows, "mix_name string, budget_ratio double, source string, target_share double, max_repeats int")
    drawn, plan, held = mixing.compose(df, targets)
    got = drawn.collect()
    whole = sum(t for t, _ in held.values())
    used = sum(r.tokens * r.repeats for r in got)
    assert abs(used - 0.2 * whole) <= 0.02 * whole and max(r.repeats for r in got if r.source == "small") <= 3
    assert {r.mix_name for r in got} == {"m"} and not any(r.doc_id >= 2000 for r in got)
    assert len(got) == len({(r.mix_name, r.doc_id) for r in got})
    report = {r.source: r for r in mixing.shares(drawn, plan).where("mix_name = 'm'").collect()}
    assert report["absent"].actual_share == 0 and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-5
    again = mixing.compose(df, targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.compose(df.limit(0), targets)[0].count() == 0 and mixing.compose(df, targets.limit(0))[0].count() == 0
    assert isinstance(got[0], Row)


def test_draw_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 100)
    docs = spark.createDataFrame([(i, "word " * (1 + i % 30), "ab"[i % 3 == 0]) for i in range(900)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", 0.3, "a", 0.5, 2), ("m", 0.3, "b", 0.5, 2)], "mix_name string, budget_ratio double, source string, target_share double, max_repeats int")
    draws = [sorted(map(tuple, mixing.compose(d, targets)[0].collect())) for d in (docs.repartition(1), docs.repartition(7, "text"), docs.orderBy("text"))]
    assert draws[0] == draws[1] == draws[2] and draws[0]
