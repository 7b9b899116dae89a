from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from loomstead.operators.incremental import KeyHashState, Overtaken, append_once, content_hash, latest_versions, plain_hash, rows_since_success
from loomstead.streaming.refresh import refresh, sittings

ROWS = "source string, source_key string, row_id long, text string, timestamp timestamp"


def state_at(spark, tmp_path):
    return KeyHashState(spark, str(tmp_path / "state"), ["source", "source_key"])


def hashed(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, source_key string, content_hash string")


def keys(df):
    return sorted((r.source, r.source_key) for r in df.collect())


def test_nothing_twice_and_nothing_skipped(spark, tmp_path):
    state = state_at(spark, tmp_path)
    first = hashed(spark, ("a", "1", "x"), ("a", "2", "y"))
    got = []
    state.run(first, lambda df, _: got.append(keys(df)))
    state.run(first, lambda df, _: got.append(keys(df)))
    state.run(hashed(spark, ("a", "2", "z"), ("b", "2", "y")), lambda df, _: got.append(keys(df)))
    assert got == [[("a", "1"), ("a", "2")], [], [("a", "2"), ("b", "2")]]
    assert {(r.source, r.source_key, r.content_hash) for r in state.read().collect()} == {("a", "1", "x"), ("a", "2", "z"), ("b", "2", "y")}


@pytest.mark.parametrize("step", ["handed", "process", "move", "commit", "clean"])
def test_failure_at_each_step(spark, tmp_path, monkeypatch, step):
    """Wherever a run fails, the next ones leave each version of a record in the output exactly once."""
    state, out = state_at(spark, tmp_path), str(tmp_path / "out")
    state.run(hashed(spark, ("a", "1", "x"), ("a", "2", "y")), append_once(out))

    def fail(*_):
        raise RuntimeError("lost")

    def process(df, number):
        append_once(out)(df, number)
        if step == "process":
            fail()

    broken = state_at(spark, tmp_path)
    if step != "process":
        monkeypatch.setattr(broken, {"handed": "changed", "move": "move", "commit": "_commit", "clean": "_clean"}[step], fail)
    second = hashed(spark, ("a", "1", "x"), ("a", "2", "z"), ("b", "1", "w"))
    with pytest.raises(RuntimeError):
        broken.run(second, process)
    # Meanwhile the source has gone on.
    third = hashed(spark, ("a", "1", "x"), ("a", "2", "v"), ("b", "1", "w"))
    state.run(third, append_once(out))
    state.run(third, append_once(out))
    got = sorted((r.source, r.source_key, r.content_hash) for r in spark.read.parquet(out).collect())
    # A run that failed before it handed anything out is as if it hadn't been.
    between = [] if step == "handed" else [("a", "2", "z")]
    assert got == sorted([("a", "1", "x"), ("a", "2", "y"), ("a", "2", "v"), ("b", "1", "w"), *between])
    assert {tuple(r) for r in state.read().collect()} == {("a", "1", "x"), ("a", "2", "v"), ("b", "1", "w")}


def test_two_writers(spark, tmp_path):
    one, other = state_at(spark, tmp_path), state_at(spark, tmp_path)

    def meanwhile(df, number):
        other.move(hashed(spark, ("b", "1", "y")), number - 1)

    with pytest.raises(Overtaken):
        one.run(hashed(spark, ("a", "1", "x")), meanwhile)
    assert keys(one.read()) == [("b", "1")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    state = state_at(spark, tmp_path)
    state.run(hashed(spark, *(("a", str(i), "x") for i in range(200))), lambda *_: None)
    before = state._version(1)["folders"]
    state.run(hashed(spark, ("a", "7", "y")), lambda *_: None)
    after = state._version(2)["folders"]
    assert len(before) > 10 and sum(before[b] != after[b] for b in before) == 1
    state.run(hashed(spark, ("a", "7", "z")), lambda *_: None)
    # The folder that only the first version needed for this bucket stays as long as others lie in it.
    assert state.read().count() == 200 and state._names("version-") == ["version-000000000002", "version-000000000003"]
    assert state._names("handed-") == ["handed-000000000003"]


def test_versions_and_ties(spark):
    rows = [
        ("a", "1", 1, "old", None), ("a", "1", 2, " new ", None), ("a", "1", 2, " new ", None),
        ("a", "2", 3, None, None), ("a", "3", 4, " 　", None),
    ]
    got = {r.source_key: r for r in latest_versions(spark.createDataFrame(rows, ROWS)).collect()}
    assert (got["1"].row_id, got["1"].content_hash) == (2, hashlib.sha256(b"new").hexdigest())
    assert got["2"].blank and got["3"].blank
    assert latest_versions(spark.createDataFrame([], ROWS)).count() == 0


def test_hash_spellings(spark):
    df = spark.createDataFrame([(" SHA256:AbC ",), ("abc",), (None,)], "h string")
    assert [r[0] for r in df.select(plain_hash(df.h)).collect()] == ["abc", "abc", None]
    long = "é" * 300_000
    assert spark.createDataFrame([(long,)], "t string").select(content_hash(F.col("t"))).first()[0] == hashlib.sha256(long.encode()).hexdigest()


def test_runs(spark):
    runs = spark.createDataFrame(
        [
            (1, "a", 10, "w", True), (2, "A ", 20, None, True), (3, "a", 30, "w", False), (4, "a", 40, None, None), (5, "b", 50, None, False), (1, "a", 10, "w", True),
        ],
        "run_id long, source string, s long, watermark string, successful boolean",
    ).selectExpr("run_id", "source", "timestamp_seconds(s) as started_at", "watermark", "successful")
    rows = spark.createDataFrame([("a", i) for i in (1, 2, 3, 4, 9)] + [("b", 5)], "source string, run_id long")
    assert sorted(r.run_id for r in rows_since_success(rows, runs).collect()) == [2, 3, 4, 5]


def test_stream(spark, tmp_path):
    state, out = state_at(spark, tmp_path), []
    inbox = str(tmp_path / "in")
    for n, text in enumerate(["one", "one", "two"]):
        spark.createDataFrame([("a", "k", n, text, None)], ROWS).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(ROWS).parquet(inbox)
        refresh(stream, state, lambda df, number: out.append([r.row_id for r in df.collect()]), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert [x for x in out if x] == [[0], [2]]


def test_sittings(spark):
    rows = [("s", 0), ("s", 1000), ("s", 1000 + 1801), ("t", 5)]
    df = spark.createDataFrame(rows, "session string, n long").selectExpr("session", "timestamp_seconds(n) as ts")
    assert sorted((r.session, r.messages) for r in sittings(df).collect()) == [("s", 1), ("s", 2), ("t", 1)]
