from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstead.functions import redact
from loomstead.functions.text import is_blank, stable_id, strip
from loomstead.operators import chunking, distill, embedding, headings, snippets
from loomstead.plans import content_queries


def crumbs(text):
    return [c for c, _ in headings.sections(text, True)]


def test_headings():
    text = "intro\n# A #\nx\n## B\n\n### C\ny\n#### D\nz\nE\n---\nq\n```sh\n# no\n```\n#no\n- item\n---\n"
    assert crumbs(text) == ["", "A", "A › B › C", "A › B › C", "A › E"]
    assert crumbs("# only") == [] and crumbs("") == [] and crumbs("  \n ") == []
    assert crumbs("~~~\n# in\n```\n# still\n~~~\n# out\nbody") == ["", "out"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n漢é", max_size=900), st.integers(100, 200), st.integers(0, 120))
def test_pack_bounds(text, target, overlap):
    chunks = chunking.pack(text, target, overlap)
    assert all(0 < len(c) <= target + min(overlap, target // 2) for c in chunks)
    squeezed = "".join(text.split())
    if overlap == 0:
        assert "".join("".join(c.split()) for c in chunks) == squeezed


def test_pack_carries_words_over():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(6))
    chunks = chunking.pack(text, 150, 40)
    assert len(chunks) > 2
    for before, after in zip(chunks, chunks[1:]):
        carried = after.split("\n\n")[0]
        assert before.endswith(carried) and not carried.startswith(" ")
    with pytest.raises(ValueError):
        chunking.pack("x", 50)


def test_sections_are_packed_under_what_they_share():
    made = chunking.pack_sections("# A\n## B\nshort\n## C\nshort too\n# D\n" + "long " * 400, 400, 50)
    assert made[0] == ("A", "short\n\nshort too")
    assert {c for c, _ in made[1:]} == {"D"} and len(made) > 4


def test_join_undoes_pack():
    text = " ".join(f"word{i}" for i in range(600))
    whole, places = chunking.joined(chunking.pack(text, 400, 0))
    assert whole.replace("\n\n", " ") == text and len(places) > 5
    whole, places = chunking.joined(["the first large part of a text", "large part of a text and more", "apart"])
    assert whole == "the first large part of a text and more\n\napart" and places[1] == (10, 39)


def dialogue(minutes):
    start = dt.datetime(2026, 7, 20, 12, tzinfo=dt.timezone.utc)
    each = (f"{('USER', 'ASSISTANT')[i % 2]} [{(start + dt.timedelta(minutes=m)).isoformat()}]\nsaid {i}" for i, m in enumerate(minutes))
    return "\n\n".join(each)


def test_units():
    assert len(chunking.units(dialogue(range(14)))) == 2
    assert len(chunking.units(dialogue([0, 1, 61, 62]))) == 2
    assert len(chunking.units(dialogue([0, 30, 60]))) == 1
    short, long = chunking.units(dialogue(range(5))), chunking.units(dialogue(range(40)))
    assert long[0][0].startswith(short[0][0]) and chunking.units(dialogue(range(30)))[:2] == long[:2]
    huge = "USER [2026-07-20T12:00:00Z]\n" + "x" * 5000
    assert all(len(u[0]) <= 2000 for u in chunking.units(huge, most=2000))
    assert chunking.units("no headers") == []


def test_chunks_and_units_of_tables(spark):
    rows = [("a", "USER [2026-07-20T12:00:00Z]\nhi\n\nASSISTANT [2026-07-20T12:01:00Z]\nyo", False), ("b", None, False), ("c", " ", True), ("d", "# H\nbody", True)]
    made = chunking.chunk_documents(spark.createDataFrame(rows, "document_id string, text string, markdown boolean"))
    got = {(r.document_id, r.ordinal): (r.breadcrumb, r.content) for r in made.collect()}
    assert got[("d", 0)] == ("H", "body") and set(got) == {("a", 0), ("d", 0)}
    units = chunking.dialogue_units(made).collect()
    assert [(u.document_id, u.unit, u.first_ordinal, u.last_ordinal) for u in units] == [("a", 0, 0, 0)]


def test_snippets():
    assert snippets.snippet("short", ["x"]) == "short"
    text = "alpha " * 100 + "lease beta floor " + "gamma " * 100 + "lease " + "delta " * 100
    got = snippets.snippet(text, ["lease", "floor", "the"], 100)
    assert "lease beta floor" in got and got.startswith("…") and got.endswith("…")
    assert snippets.snippet(text, ["the", "a"], 50) == text[:50].strip() + "…"
    assert "the" not in snippets.snippet(text, ["zzz"], 50)


def test_redaction(spark):
    said = [
        "key sk-abcdefghijklmnop12 x", "ghp_" + "a" * 24, "AKIA" + "B" * 16, "Authorization: Bearer abc", "password = hunter22", "pwd is x", "plain secretary",
        "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", None, "",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    once = df.select("i", redact.redact(F.col("s")).alias("s"))
    got = [r.s for r in once.orderBy("i").collect()]
    assert got[:8] == ["key [REDACTED] x", "[REDACTED]", "[REDACTED]", "Authorization: Bearer [REDACTED]", "password =[REDACTED]", "pwd is [REDACTED]", "plain secretary", "[REDACTED]"]
    assert got[8:] == [None, ""]
    assert [r.s for r in once.select("i", redact.redact(F.col("s")).alias("s")).orderBy("i").collect()] == got


def test_text_expressions(spark):
    df = spark.createDataFrame([(" 　a b ",), ("\n ",), (None,), ("",)], "s string")
    assert [tuple(r) for r in df.select(strip(F.col("s")), is_blank(F.col("s"))).collect()] == [("a b", False), ("", True), (None, True), ("", True)]
    ids = df.select(stable_id("doc", F.lit("a"), F.lit("b"))).distinct().collect()
    assert len(ids) == 1 and len(ids[0][0]) == 36


def test_distilled(spark):
    text = "USER [2026-07-20T12:00:00Z]\nPlease fix app.py?\n\nASSISTANT [2026-07-20T12:01:00Z]\nDone in app.py, see ABC-12. No response needed."
    got = distill.extract(spark.createDataFrame([(text,), ("USER [x]\nalone",)], "text string"))
    rows = got.select("distilled", distill.flattened(F.col("distilled")).alias("flat")).collect()
    assert rows[0].distilled.user_goal == "Please fix app.py?" and "app.py" in rows[0].distilled.artifacts
    assert rows[0].flat.splitlines()[0] == "User Goal: Please fix app.py?" and "Keywords: ABC-12" in rows[0].flat
    assert rows[1].distilled.summary == ""


def test_inverted_file_recall(spark, tmp_path):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((1000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_pk long, embedding array<float>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(8)], "query_id int, vector array<float>")
    got = embedding.InvertedFile(df, 12, str(tmp_path)).search(queries, 50, 10).collect()
    found = sum(r.chunk_pk in set(np.argsort(-(x @ x[r.query_id]))[:50]) for r in got)
    assert found / 400 >= 0.95


def test_inverted_file_takes_all_queries(spark, small):
    got = content_queries.ann_topk(spark, small).collect()
    asked = [r.vec_id for r in spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id % 50 = 0").collect()]
    assert len(asked) > 4 and sorted((r.query_id, r["rank"]) for r in got) == [(q, n) for q in sorted(asked) for n in range(1, 51)]


def test_queries_stay_a_table(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "chunk_pk long, embedding array<float>")
    queries = spark.createDataFrame([(2**40 + i, None if i == 2 else [1.0, float(i)]) for i in range(3)], "query_id long, vector array<float>")
    got = embedding.InvertedFile(df, 2, str(tmp_path)).search(queries, 4, 2).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(2**40 + i, n) for i in range(2) for n in range(1, 5)]


def test_hashed_vectors(spark):
    v = embedding.hashed_vector("Lease lease floor", 32)
    assert np.isclose(np.linalg.norm(v), 1) and (embedding.hashed_vector("", 32) == 0).all()
    got = spark.createDataFrame([("a b",), (None,)], "s string").select(embedding.hashed(F.col("s"), 16).alias("v")).collect()
    assert len(got[0].v) == 16 and got[1].v is None
