from __future__ import annotations

import importlib.util
import json
import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomstead.operators import dialogue, evaluation, hybrid, lexical, store
from loomstead.sources import jsonl, projects

CHUNKS = "chunk_pk long, title string, content string"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert (importlib.util.find_spec("loomstead.llm") is None) == (not any(q.startswith("p1_") for q in queries))


def test_entry(spark, small):
    assert entry.entry(spark).columns[0] == "query_id"


def test_bm25_phrases_and_ties(spark):
    rows = [(1, "Lease", "the lease floor"), (2, "x", "lease floor lease"), (3, "x", "floor of the lease"), (4, None, None), (5, "x", "nothing"), (6, "x", "re embedded"), (7, "x", "embedded re")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(1, "the re-embedded"), (2, "Lease"), (3, "zzz"), (4, "")], "query_id int, query string")
    got = {(r.query_id, r.chunk_pk): r.score for r in lexical.bm25(chunks, queries).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 6)} and {k for k in got if k[0] == 2} == {(2, 1), (2, 2), (2, 3)}
    sizes = [4, 4, 5, 0, 2, 3, 3]
    avg, idf, tf = sum(sizes) / 7, max(1e-6, math.log((7 - 3 + 0.5) / 3.5)), 3.0
    assert math.isclose(got[2, 1], idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 4 / avg)))
    tied = spark.createDataFrame([(1, 9, 1.0), (1, 3, 1.0)], "query_id int, chunk_pk long, score double")
    assert [r.chunk_pk for r in lexical.ranked(tied, 1).collect()] == [3]
    assert lexical.bm25(spark.createDataFrame([], CHUNKS), queries).count() == 0


def test_stopword_queries_and_caps(spark):
    queries = spark.createDataFrame([(1, "the and of"), (2, "the lease lease floor")], "query_id int, query string")
    words = {r.query_id: r.w for r in queries.select("query_id", lexical.query_words(queries.query).alias("w")).collect()}
    assert words == {1: ["the", "and", "of"], 2: ["lease", "floor"]}
    known = spark.createDataFrame([("lease", 9)], "term string, n long")
    assert [r.word for r in lexical.capped_terms(queries.where("query_id = 2"), known, 1).collect()] == ["floor"]


def test_fusion_and_best_chunks(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_pk long, rank int")
    b = spark.createDataFrame([(1, 11, 1)], "query_id int, chunk_pk long, rank int")
    got = {r.chunk_pk: r.rrf for r in hybrid.fuse(a, b).collect()}
    assert math.isclose(got[11], 1 / 62 + 1 / 61) and math.isclose(got[10], 1 / 61)
    rows = [(1, "d", 5, 0.5), (1, "d", 4, 0.5), (1, "e", 9, 0.5)]
    best = hybrid.best_of_each_document(spark.createDataFrame(rows, "query_id int, document_id string, chunk_pk long, score double"))
    assert [(r.document_id, r.chunk_pk, r.position) for r in best.orderBy("position").collect()] == [("d", 4, 1), ("e", 9, 2)]


def test_variants(spark):
    chunks = spark.createDataFrame([("d", 0, 1), ("d", 1, 2), ("d", 2, 3), ("e", 0, 9)], "document_id string, ordinal int, chunk_pk long")
    anchors = spark.createDataFrame([(1, "d", 2, 1), (1, "e", 9, 0)], "query_id int, document_id string, chunk_pk long, ordinal int")
    made = hybrid.variants(anchors, chunks)
    assert sorted((r.document_id, r.direction, tuple(r.chunk_pks)) for r in made.collect()) == [("d", "next", (2, 3)), ("d", "previous", (1, 2)), ("e", "anchor", (9,))]
    scores = spark.createDataFrame([(1, 1, 0.4)], "query_id int, chunk_pk long, score double")
    assert {r.document_id: r.direction for r in hybrid.fallback_variant(made, scores).collect()} == {"d": "previous", "e": "anchor"}
    assert {r.document_id: r.direction for r in hybrid.fallback_variant(made, scores.limit(0)).collect()} == {"d": "next", "e": "anchor"}


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 9)], "query_id int, document_id string, position int")
    judged = spark.createDataFrame([(1, "b", 2.0), (1, "z", 1.0), (1, "n", 0.0), (2, "c", 1.0), (3, "q", 1.0)], "query_id int, document_id string, gain double")
    got = {r.query_id: r for r in evaluation.case_metrics(ranking, judged).collect()}
    assert (got[1].recall_at_8, got[1].mrr_at_8) == (0.5, 0.5) and math.isclose(got[1].ndcg_at_10, (2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert (got[2].recall_at_8, got[2].recall_at_20, got[2].mrr_at_8) == (0.0, 1.0, 0.0) and got[3].ndcg_at_10 == 0.0
    means = evaluation.means(evaluation.case_metrics(ranking, judged))
    assert {r.metric: r.broken for r in evaluation.floors(means).collect()} == dict.fromkeys(evaluation.FLOORS, True)


def test_store(spark):
    held = spark.createDataFrame([("p", str(i), f"d{i}", "h", None) for i in range(20)], "source string, source_key string, document_id string, content_hash string, ts timestamp")
    see = lambda n: spark.createDataFrame([("p", str(i)) for i in range(n)], "source string, source_key string")
    assert store.unseen(held, see(1)).count() == 0 and store.unseen(held, see(18)).count() == 2
    assert store.unseen(held.limit(9), see(1)).count() == 8
    new = spark.createDataFrame([("p", "0", "h"), ("p", "1", "i"), ("q", "0", "h")], "source string, source_key string, content_hash string")
    assert sorted(r.status for r in store.classify(new, held).collect()) == ["created", "unchanged", "updated"]


def test_receipts_come_back(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "x", 1), ("b", "y", 5)]
    df = spark.createDataFrame(rows, "k string, content_hash string, at long")
    got = {(r.artifact, r.created_at): r.superseded_at for r in store.receipts(df, df.k, ["at"], "at").collect()}
    assert got == {("a", 1): None, ("a", 2): 3, ("b", 1): 5, ("b", 5): None}


def test_role_runs(spark):
    rows = [("s", 1, "user", "a", "1"), ("s", 2, "user", "b", "3"), ("s", 3, "end", None, "4"), ("s", 4, "user", "c", "5"), ("s", 5, "assistant", "d", "6"), ("s", 6, "assistant", None, "7")]
    got = dialogue.role_runs(spark.createDataFrame(rows, "session string, place int, kind string, text string, ts string")).orderBy("run").collect()
    assert [(r.role, r.text, r.ts) for r in got] == [("user", "ab", "3"), ("user", "c", "5"), ("assistant", "d", "7")]


def test_session_files(spark, tmp_path):
    folder = tmp_path / "x" / "y"
    folder.mkdir(parents=True)
    lines = [
        {"type": "user", "sessionId": "s", "timestamp": "2026-07-01T00:00:00Z", "message": {"role": "user", "content": "password: abcd1234"}},
        {"type": "assistant", "sessionId": "s", "timestamp": "2026-07-01T00:01:00Z", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "thinking", "text": "no"}]}},
        {"type": "user", "isSidechain": True, "timestamp": "2026-07-01T00:01:00Z", "message": {"role": "user", "content": "side"}},
        {"id": "h", "messages": [{"role": "user", "content": "q", "timestamp": "2026-07-01T00:00:00Z"}, {"role": "tool", "content": "t", "timestamp": "2026-07-01T00:00:00Z"}, {"role": "assistant", "content": "undated"}]},
    ]
    (folder / "a.jsonl").write_text("\n".join([*(json.dumps(x) for x in lines), "{broken", "", "[1]", '{"a": 1} x', '{"a": 1}] x', '{"a": 1}} x', '{"a": 1}, {"b": 2}']))
    read = jsonl.read_lines(spark, [str(tmp_path / "x"), str(tmp_path / "missing")])
    assert [(r.scanned, r.malformed) for r in jsonl.scan_summary(read).collect()] == [(10, 6)]
    assert [(r.role, r.text) for r in jsonl.agent_messages(read).orderBy("ts").collect()] == [("user", "password:[REDACTED]"), ("assistant", "hi")]
    assert [(r.session, r.role, r.text) for r in jsonl.exported_messages(read).collect()] == [("h", "user", "q")]
    with pytest.raises(FileNotFoundError):
        jsonl.read_lines(spark, [str(tmp_path / "missing")])


def test_project_files(spark, tmp_path):
    root = tmp_path / "root"
    for name, data in {
        "a/README.md": b"# hi", "a/node_modules/x.md": b"no", "a/code.py": b"no", "b/Notes.TXT": b"\xef\xbb\xbftext", "b/credentials.txt": b"no", "b/tokenizer-notes.md": b"yes",
        "b/nul.md": b"a\0b", "b/big.md": b"x" * 3000, "b/empty.md": b"", "b/bad.md": b"\xff\xfe\xfa", "top.mdx": b"top",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.source_key: (r.project, r.text, r.status) for r in projects.scan(spark, str(root), 2000).collect()}
    assert got == {
        "a/readme.md": ("a", "# hi", "read"), "b/notes.txt": ("b", "text", "read"), "b/tokenizer-notes.md": ("b", "yes", "read"), "top.mdx": ("root", "top", "read"),
        "b/nul.md": ("b", None, "kept"), "b/big.md": ("b", None, "kept"), "b/bad.md": ("b", None, "kept"),
    }


def test_visible_text(spark):
    contents = {
        '"[WARN] please fix"': "[WARN] please fix", '["a", {"type": "text", "text": "b"}, {"text": "c"}, {"type": "image", "text": "d"}, 3]': "a\nb", '{"text": "z"}': "z",
        '{"type": "Input_Text", "text": "y"}': "y", '{"type": "thinking", "text": "x"}': "", "5": "", "null": "", '""': "", '[{"type": "text", "text": 5}]': "",
    }
    df = spark.createDataFrame([(f'{{"c": {c}}}',) for c in contents] + [("{}",)], "raw string")
    got = df.select(jsonl.visible_text(F.try_variant_get(F.try_parse_json("raw"), "$.c", "variant")).alias("t")).collect()
    assert [r.t for r in got] == [*contents.values(), ""]


def test_session_scans(spark, tmp_path):
    def write(name, *lines):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))

    new, old = "2026-07-20T10:00:00Z", "2026-01-01T00:00:00Z"
    said = lambda role, text, ts, **more: {"type": role, "timestamp": ts, "message": {"role": role, "content": text}, **more}
    write("claude/proj/a.jsonl", {"type": "summary"}, said("user", "\n<system-reminder>x</system-reminder>\n[hello]\n", new, sessionId="s1", cwd="/home/me/harbor"), said("assistant", " \n", new), said("assistant", "hi", "1784541600"), "{bad")
    write("claude/proj/b.jsonl", said("user", "late", old, sessionId="s2"), said("assistant", "undated", None))
    got = {r.source_key: r for r in jsonl.scan(jsonl.read_lines(spark, [str(tmp_path / "claude")]), "claude", "2026-07-01 00:00:00").collect()}
    assert got["session:s1"].text == f"USER [{new}]\n[hello]\n\nASSISTANT [{new}]\nhi" and (got["session:s1"].project, got["session:s1"].message_count) == ("harbor", 2)
    assert (got["session:s2"].status, got["session:s2"].text, got["session:s2"].project) == ("kept", None, "proj")
    item = lambda kind, **payload: {"type": kind, "timestamp": new, "payload": payload}
    write("codex/x/rollout-1.jsonl", item("session_meta", id="c1", cwd="C:\\work\\aurora"), item("event_msg", type="user_message", message="mirror"), item("response_item", type="message", role="user", content=[{"type": "input_text", "text": "real"}]))
    write("codex/x/rollout-2.jsonl", item("event_msg", type="user_message", message="only"), item("response_item", type="message", role="user", content=[{"type": "image"}]), item("event_msg", type="agent_message", text="answer"))
    got = {r.source_key: r for r in jsonl.scan(jsonl.read_lines(spark, [str(tmp_path / "codex")]), "codex").collect()}
    assert got["session:c1"].text == f"USER [{new}]\nreal" and got["session:c1"].project == "aurora"
    assert got["session:rollout-2"].text == f"USER [{new}]\nonly\n\nASSISTANT [{new}]\nanswer"
    chunk = lambda kind, text, ts=new: {"timestamp": ts, "params": {"sessionId": "g1", "update": {"sessionUpdate": kind, "content": text}}}
    write("grok/%2Fhome%2Fme%2Fmeadow/g-dir/updates.jsonl", chunk("user_message_chunk", "a", old), chunk("user_message_chunk", {"type": "text", "text": "b"}), chunk("tool_call", "no"), chunk("user_message_chunk", "c", None), chunk("turn_completed", None), chunk("user_message_chunk", "d"), chunk("agent_message_chunk", "e"))
    lines = jsonl.read_lines(spark, [str(tmp_path / "grok")])
    (got,) = jsonl.scan(lines, "grok", "2026-07-01 00:00:00").collect()
    assert (got.source_key, got.project, got.text) == ("session:g1", "meadow", f"USER [{new}]\nabc\n\nUSER [{new}]\nd\n\nASSISTANT [{new}]\ne")
    assert jsonl.watermark(jsonl.scan(lines, "grok"), old).first()[0].isoformat().startswith("2026-07-20T10:00")


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_runs_across_blocks(spark, monkeypatch, size):
    import random

    from loomstead.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", size)
    rng = random.Random(size)
    rows = [(s, i, rng.choice("abb")) for s in range(3) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "s int, place int, kind string").withColumn("b", blocks.block(F.col("place")))
    got = {(r.s, r.place): (r.prev, r.nth) for r in blocks.runs(df, ["s"], ["b"], ["place"], "kind", lambda p, k: ~p.eqNullSafe(k)).collect()}
    for s in range(3):
        before, n = None, 0
        for _, i, kind in (r for r in rows if r[0] == s):
            n += kind != before
            assert got[s, i] == (before, n)
            before = kind
