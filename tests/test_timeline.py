from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomstead.functions import timestamps as ts
from loomstead.operators import timeline

UTC = dt.timezone.utc


def micros(*of):
    return int(dt.datetime(*of, tzinfo=UTC).timestamp()) * 1_000_000


NEW_YORK = "America/New_York"
CASES = [
    ("2025-08-01T08:07:24Z", None, [micros(2025, 8, 1, 8, 7, 24)]),
    ("2025-08-01t08:07:24z", None, [micros(2025, 8, 1, 8, 7, 24)]),
    (" 2025-08-31T08:18:07+00:00 ", None, [micros(2025, 8, 31, 8, 18, 7)]),
    ("2025-08-03T22:39:42.689537358Z", None, [micros(2025, 8, 3, 22, 39, 42) + 689537]),
    ("2025-07-31 18:35:25,736", None, [micros(2025, 7, 31, 18, 35, 25) + 736000]),
    ("2025-08-01T22:53:18.482+0200", NEW_YORK, [micros(2025, 8, 1, 20, 53, 18) + 482000]),
    ("2025-08-01 20:59:26+00", NEW_YORK, [micros(2025, 8, 1, 20, 59, 26)]),
    ("2025-08-04T15:25+01:00", None, [micros(2025, 8, 4, 14, 25)]),
    ("2025-08-23T12:45:45-04:00[America/New_York]", None, [micros(2025, 8, 23, 16, 45, 45)]),
    ("20250804T104152Z", None, [micros(2025, 8, 4, 10, 41, 52)]),
    ("03.08.2025 21:47", None, [micros(2025, 8, 3, 21, 47)]),
    ("08/10/2025 12:19:40 AM", None, [micros(2025, 8, 10, 0, 19, 40)]),
    ("31/07/2025 06:36:13 PM", None, []),
    ("08/10/2025 13:19:40 AM", None, []),
    ("Aug 1, 2025, 1:08:26 PM", None, [micros(2025, 8, 1, 13, 8, 26)]),
    ("Sun, 10 Aug 2025 12:19:32 +1000", None, [micros(2025, 8, 10, 2, 19, 32)]),
    ("2025-08-01 09:50:25 UTC", NEW_YORK, [micros(2025, 8, 1, 9, 50, 25)]),
    ("2025-11-02 01:05:46 EST", NEW_YORK, [micros(2025, 11, 2, 6, 5, 46)]),
    ("2025-11-02 01:05:46 EDT", NEW_YORK, [micros(2025, 11, 2, 5, 5, 46)]),
    ("2025-11-02 01:05:46 XYZ", NEW_YORK, [micros(2025, 11, 2, 5, 5, 46), micros(2025, 11, 2, 6, 5, 46)]),
    ("2025-11-02 01:05:46", NEW_YORK, [micros(2025, 11, 2, 5, 5, 46), micros(2025, 11, 2, 6, 5, 46)]),
    ("2026-03-08 02:30:00", NEW_YORK, [micros(2026, 3, 8, 7, 30)]),
    ("2026-04-05 01:45:00", "Australia/Lord_Howe", [micros(2026, 4, 4, 14, 45), micros(2026, 4, 4, 15, 15)]),
    ("1754210496", None, [1754210496_000000]),
    ("1754171552.3219999", None, [1754171552_321999]),
    ("1754169262280", None, [1754169262280_000]),
    ("1754169707079774", None, [1754169707079774]),
    ("1754211368264783713", None, [1754211368264783]),
    ("20250804", None, []),
    ("2026-06-31 09:00:00", None, []),
    ("2025-08-01 24:00:00", None, []),
    ("2025-08-01 10:00:60", None, []),
    ("25:61", None, []),
    ("n/a", None, []),
    ("", None, []),
    ("x" * 100_000, None, []),
    (None, NEW_YORK, []),
]


def test_readings(spark):
    rows = [(i, raw, zone) for i, (raw, zone, _) in enumerate(CASES)]
    known = {f"{NEW_YORK}|{a}": s for a, s in ts.abbreviations(NEW_YORK).items()}
    df = spark.createDataFrame(rows, "row_id int, raw string, zone string")
    got = {r.row_id: [x.us for x in r.readings] for r in timeline.readings(df, "raw", F.col("zone"), known).collect()}
    for i, (raw, zone, want) in enumerate(CASES):
        assert got[i] == want, (raw and raw[:60], zone)


def rule(rows):
    """The plain rule: the first reading, unless it is before the row before by the minute."""
    out, last = {}, None
    for row_id, choices in rows:
        if not choices:
            continue
        us = choices[0]
        if len(choices) > 1 and last is not None and us // 60_000_000 < last // 60_000_000:
            us = choices[1]
        out[row_id] = last = us
    return out


@pytest.mark.parametrize("block", [2, 7, 1_000])
def test_settle_follows_the_rule_across_blocks(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(timeline, "BLOCK", block)
    rng, hour = random.Random(4), 3_600_000_000
    rows, want = [], {}
    for session in ("a", "b", None):
        own = []
        for place in range(60):
            first = 10**15 + rng.randrange(8) * hour // 4
            choices = rng.choice([[], [first], [first, first + hour], [first, first + hour]])
            own.append((len(rows), choices))
            rows.append(("s", session, place // 2, len(rows), [(c, "iso") for c in choices]))
        if session is not None:
            want |= rule(own)
    df = spark.createDataFrame(rows, "source string, session string, place int, row_id long, readings array<struct<us:long,form:string>>")
    got = {r.row_id: r.epoch_us for r in timeline.settle(df).where("row_id < 120").collect()}
    assert got == {k: v for k, v in want.items() if k < 120}


def test_rows_without_a_session_keep_their_instant(spark):
    hour = 3_600_000_000
    rows = [("s", None, 1, 0, [10**15 + 2 * hour]), ("s", None, 2, 1, [10**15, 10**15 + hour]), ("s", "1", 1, 2, [10**15 + 2 * hour]), ("s", "1", 2, 3, [10**15, 10**15 + hour])]
    rows = [(*r[:4], [(c, "iso") for c in r[4]]) for r in rows]
    df = spark.createDataFrame(rows, "source string, session string, place int, row_id long, readings array<struct<us:long,form:string>>")
    got = {r.row_id: r.epoch_us for r in timeline.settle(df).collect()}
    # Nothing is known to come before a row without a session.
    assert got == {0: 10**15 + 2 * hour, 1: 10**15, 2: 10**15 + 2 * hour, 3: 10**15 + hour}


def test_viterbi_prefers_one_spelling():
    path = timeline.Viterbi(None)
    day, month = 86_400_000_000, 30 * 86_400_000_000
    out = []
    for n in range(4):
        out += path.add((n,), [(10**15 + n * day, "day"), (10**15 + n * month, "month")] if n else [(10**15, "day")])
    out += path.close()
    assert [us for _, us in out] == [10**15 + n * day for n in range(4)]


def test_empty(spark):
    df = spark.createDataFrame([], "source string, session string, place int, row_id long, readings array<struct<us:long,form:string>>")
    assert timeline.settle(df).count() == 0


def test_query(spark, small):
    from loomstead.plans import QUERIES

    got = QUERIES["p3_found"](spark, small)
    assert got.columns == ["source", "row_id", "epoch_us"]
    assert got.count() == got.select("source", "row_id").distinct().count() > 0


def test_slashed_dates_by_their_source(spark):
    """Read both ways, a source's slashed dates follow the spelling that its certain dates and their order ask for."""
    day = ["03/07/2026 10:00:00", "04/07/2026 10:00:00", "05/07/2026 10:00:00", "13/07/2026 10:00:00", "14/07/2026 10:00:00"]
    month = ["07/03/2026 10:00:00", "07/04/2026 10:00:00", "07/05/2026 10:00:00", "07/13/2026 10:00:00", "07/14/2026 10:00:00"]
    rows = [("s", "day", n, n, d) for n, d in enumerate(day)] + [("s", "month", n, 10 + n, d) for n, d in enumerate(month)]
    df = spark.createDataFrame(rows, "source string, session string, place int, row_id long, raw string")
    both = timeline.readings(df, "raw", F.lit(None).cast("string"), {}, day_first_slashes=None)
    # The fifth of July is another day either way; days after the twelfth can't be months.
    assert {r.row_id: len(r.readings) for r in both.collect()} == {i: 1 if i % 10 > 2 else 2 for i in (*range(5), *range(10, 15))}
    got = {r.row_id: r.epoch_us for r in timeline.settle(both).collect()}
    want = [micros(2026, 7, d, 10) for d in (3, 4, 5, 13, 14)]
    assert [got[i] for i in range(5)] == want and [got[10 + i] for i in range(5)] == want
    for how, alone in ((False, "month"), (True, "day")):
        one = timeline.readings(df.where(F.col("session") == alone), "raw", F.lit(None).cast("string"), {}, day_first_slashes=how)
        assert sorted(r.readings[0].us for r in one.collect()) == want


def test_long_open_stretches_take_linear_time():
    import time

    def walk(n):
        began, path, out = time.perf_counter(), timeline.Viterbi(10**15 + 3_600_000_000 * 2), []
        for i in range(n):
            out += path.add((i,), [(10**15, "iso"), (10**15 + 3_600_000_000, "iso")])
        out += path.close()
        assert [k[0] for k, _ in out] == list(range(n))
        return time.perf_counter() - began

    assert walk(40_000) < 20 * max(walk(4_000), 0.02)
