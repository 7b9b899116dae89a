from __future__ import annotations

import random

import pytest

from loomstead.llm import conversations as cv
from loomstead.operators import blocks
from loomstead.llm.components import components


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(500, i) for i in range(300)] + [(900, 901)],
    }[kind]
    edges = [(u, v) for u, v in edges if u != v]
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "u long, v long")
    assert {r.node: r.component for r in components(df).collect()} == union_find(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links(spark):
    rows = [("a", None, "hello there"), ("b", "a", "fine"), ("c", None, "> hello there\n\nwhat?"), ("d", "gone", "alone"), ("e", None, None), (None, "a", "x"), ("f", None, "")]
    got = {r.message_id: r.conversation for r in cv.link_sessions(spark.createDataFrame(rows, "message_id string, reply_to string, content string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}


def test_links_of_quoted_lines(spark):
    text = "first point\nsecond point\n\nthird point\nand its end"
    rows = [("a", None, text), ("b", None, "> second point\n\nwhy?"), ("c", None, "> third point\n> and its end\nno"), ("d", None, "> first point\n> second point\n\nboth"), ("e", None, "> never said\n\nhm"), ("f", None, "> never said\n\nhm too")]
    got = {r.message_id: r.conversation for r in cv.link_sessions(spark.createDataFrame(rows, "message_id string, reply_to string, content string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}


HERMES = "row_id long, session_id string, seq int, role string, content string, timestamp string, ingested_at long, unit string"


def hermes(spark, rows):
    full = [(i, s, q, r, c, None, i, "x") for i, (s, q, r, c) in enumerate(rows)]
    events = cv.hermes_events(spark.createDataFrame(full, HERMES))
    none = spark.createDataFrame([], "source string, unit string, session string")
    return {(r.session_id, r.row_id, r.turn) for r in cv.rebuild(events, none).collect()}


@pytest.mark.parametrize("block", [65_536, 2])
def test_kept_and_left_out(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    good = [("ok", 5, " Human ", "q"), ("ok", 6, "tool", "t"), ("ok", 7, "AI", "a"), ("ok", 7, "AI", "a"), ("ok", 8, "model", "b"), ("ok", 9, "user", " \xa0"), ("ok", 10, "user", "q" * 50_000), ("ok", 11, "assistant", "c")]
    bad = [
        ("gap", 0, "user", "q"), ("gap", 2, "assistant", "a"), ("clash", 0, "user", "q"), ("clash", 1, "assistant", "a"), ("clash", 1, "assistant", "b"),
        ("first", 0, "assistant", "a"), ("first", 1, "user", "q"), ("first", 2, "assistant", "a"), ("last", 0, "user", "q"), ("empty", 0, "user", None), ("norole", 0, "user", "q"),
        ("norole", 1, None, "x"), ("norole", 2, "assistant", "a"), ("twice", 0, "user", "q"), ("twice", 1, "user", "q"), ("twice", 2, "assistant", "a"), (None, 0, "user", "q"),
        ("noplace", None, "user", "q"), ("noplace", 1, "assistant", "a"),
    ]
    assert hermes(spark, good + bad) == {("ok", 0, 1), ("ok", 2, 2), ("ok", 4, 3), ("ok", 6, 4), ("ok", 7, 5)}


def test_empty(spark):
    assert hermes(spark, []) == set()


GROK = "row_id long, cwd string, line_no int, timestamp string, method string, params struct<sessionId:string,update:struct<sessionUpdate:string,content:string>>"


@pytest.mark.parametrize("block", [65_536, 3])
def test_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    u, a, e = "user_message_chunk", "AGENT_MESSAGE_CHUNK ", "turn_completed"
    lines = [(u, "he"), ("plan", None), (u, '{"type": "text", "text": "llo"}'), (a, " "), (a, "yes"), (e, None), (a, "more"), (u, " "), (u, '{"type":"text","text":" "}'), (a, "end")]
    rows = [(i, "w", i + 1, None, "m", ("s", (k, c))) for i, (k, c) in enumerate(lines)] + [(99, "w", 1, None, "m", ("t", None)), (98, "w", 1, None, "m", None)]
    events = cv.grok_events(spark.createDataFrame(rows, GROK))
    none = spark.createDataFrame([], "source string, unit string, session string")
    got = {(r.row_id, r.turn) for r in cv.rebuild(events, none).collect()}
    # The blank user message is none, but parts the answers around it.
    assert got == {(0, 1), (2, 1), (3, 2), (4, 2), (6, 3), (9, 4)}


CODEX = "row_id long, file string, line_no int, type string, timestamp string, payload struct<type:string,role:string,id:string,cwd:string,message:string,content:array<struct<type:string,text:string>>>"


def test_files_of_a_session(spark, tables):
    say = lambda role, text: ("message", role, None, None, None, [("input_text", text)])
    event = lambda kind, text: (kind, None, None, None, text, None)
    rows = [
        (1, "d/a.jsonl", 1, "session_meta", None, (None, None, "S", "w", None, None)), (2, "d/a.jsonl", 2, "response_item", None, say("User", "q")),
        (3, "d/b.jsonl", 1, "session_meta", None, (None, None, "S", "w", None, None)), (4, "d/b.jsonl", 2, "response_item", None, say("assistant", "a")),
        (5, "d/b.jsonl", 3, "event_msg", None, event("agent_message", "mirror")), (6, "d/c.jsonl", 1, "event_msg", None, event("user_message", "q")),
        (7, "d/c.jsonl", 2, "event_msg", None, event("agent_message", "a")), (8, "d/e.jsonl", 1, None, None, None), (9, "d/f.jsonl", 1, "response_item", None, ("message", "user", None, None, None, None)),
    ]
    folder = tables(
        codex_records=spark.createDataFrame(rows, CODEX),
        hermes_messages=spark.createDataFrame([], HERMES),
        grok_records=spark.createDataFrame([], GROK),
    )
    turns = cv.conversations(spark, folder)
    assert {(r.session_id, r.row_id, r.turn) for r in turns.collect()} == {("S", 2, 1), ("S", 4, 2), ("c", 6, 1), ("c", 7, 2)}
    texts = {(r.session_id, r.turn): (r.role, r.text) for r in cv.with_texts(turns, spark, folder).collect()}
    assert texts[("S", 1)] == ("user", "q") and texts[("c", 2)] == ("assistant", "a")


def test_linked_conversations(spark):
    rows = [
        ("a", None, 1, "user", "how do I renew the lease?", 10), ("b", "a", 2, "ai", "like this", 20), ("b", "a", 9, "ai", "like this", 20),
        ("c", None, 3, "user", "> like this\n\nand then?", 30), ("d", "c", 4, "assistant", "then that", 40),
        ("e", None, 5, "user", "alone", 50), ("f", "nobody", 6, "assistant", "answers nobody", 60), (None, "a", 7, "user", "nameless", 70),
    ]
    df = spark.createDataFrame(rows, "message_id string, reply_to string, row_id long, role string, content string, at long")
    got = sorted((r.session_id, r.row_id, r.turn) for r in cv.linked_conversations(df).collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4)]
    assert cv.linked_conversations(df.limit(0)).count() == 0


def test_planted_links(spark, small):
    from loomstead.llm import queries

    got = {(r.row_id, r.conversation) for r in queries.p2_linked(spark, small).collect()}
    rows = spark.read.parquet(f"{small}/hermes_messages.parquet").where("session_id is not null").select("session_id", "row_id").collect()
    least: dict = {}
    for r in rows:
        least[r.session_id] = min(least.get(r.session_id, r.row_id), r.row_id)
    assert got == {(r.row_id, least[r.session_id]) for r in rows}
