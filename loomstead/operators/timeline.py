"""One instant for each record of mixed timestamp spellings, precisions and zones.

Every value gets an array of its valid readings, each with the spelling that it supposes. Where there are several, the sequence of a source's records
decides: a Viterbi pass takes the path of least cost, in which a reading costs by how far it is from the earliest
that doesn't jump back in time, and a change of spelling costs extra. A record with a single reading fixes the
path on both sides, so only the stretches in between are walked, each by itself, and sources without an
ambiguous record aren't sorted at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import timestamps as ts
from loomstead.session import small, table, write_once

#: Cost of a change between spellings that read the same text differently.
SWITCH = 0.25
MINUTE = 60_000_000
#: Places of a source that are sorted together; what comes before a block is carried into it.
BLOCK = 65_536


def readings(df: DataFrame, raw: str, zone: Column, abbreviation: dict[str, int], day_first_slashes: bool | None = False) -> DataFrame:
    """Add `readings`, an array of structs (us, form): all valid instants of the text, earliest reading first.

    zone: the zone of times without one; null is UTC. abbreviation: "ZONE|ABBR" → seconds. Null, blank and
    unreadable texts and dates that don't exist have an empty array. day_first_slashes: whether slashed dates begin
    with the day; None reads them both ways, as two spellings, and leaves the choice to settle().
    """
    df = df.withColumn("_zone", F.coalesce(zone, F.lit("UTC"))).withColumn("_f", ts.fields(F.col(raw)))
    turned = ts.swapped(F.col("_f"))
    if day_first_slashes is None:
        df = df.withColumn("_t", turned)
        both = _readings(_readings(df, "_f", "readings", abbreviation), "_t", "_more", abbreviation)
        # A date that reads the same both ways has one spelling.
        other = F.filter("_more", lambda x: ~F.exists("readings", lambda y: y.us == x.us))
        return both.withColumn("readings", F.array_sort(F.concat("readings", other))).drop("_zone", "_f", "_t", "_more")
    if day_first_slashes:
        df = df.withColumn("_f", F.coalesce(turned, "_f"))
    return _readings(df, "_f", "readings", abbreviation).drop("_zone", "_f")


def _readings(df: DataFrame, fields: str, out: str, abbreviation: dict[str, int]) -> DataFrame:
    given, cols = df.columns, ts.read(F.col(fields))
    df = df.select("*", *(c.alias(f"_{k}") for k, c in cols.items()), F.col(f"{fields}.form").alias("_form"), F.col("_zone").alias("_at"))
    if abbreviation:
        table_ = F.create_map(*(F.lit(x) for kv in abbreviation.items() for x in kv))
        named = F.try_element_at(table_, F.concat_ws("|", "_zone", "_mark")).cast("long") * 1_000_000
    else:
        named = F.lit(None).cast("long")
    region = F.when(F.col("_region").isin(*ts.known_zones()), F.col("_region"))
    df = df.withColumn("_offset", F.coalesce("_offset", named)).withColumn("_at", F.coalesce(region, "_at"))
    first = F.when(F.col("_wall").isNotNull() & F.col("_offset").isNull(), ts.first_reading(F.col("_wall"), F.col("_at")))
    df = df.withColumn("_first", first)
    second = F.when(F.col("_first").isNotNull() & (F.col("_at") != "UTC"), ts.second_reading(F.col("_wall"), F.col("_first"), F.col("_at")))
    one = [F.col("_epoch"), F.col("_wall") - F.col("_offset"), F.col("_first"), second]
    form = F.coalesce("_form", F.lit("number"))
    made = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(c.alias("us"), form.alias("form"))) for c in one)))
    return df.select(*(f"`{c}`" for c in given), made.alias(out))


def settle(df: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Choose one reading for each row of (source, session, place, row_id, readings): rows (source, row_id, epoch_us).

    wanted: which rows to give out; all take part in the choice. The readings are written down once, as they are
    dear to make and used by each of the passes.

    Rows without a reading are left out. Order within a session is by place, then row_id. A row without a session has
    no row before it: it is a session of its own.
    """
    wanted = F.lit(True) if wanted is None else wanted
    # The mark keeps these keys apart from names of sessions.
    own = F.coalesce(F.concat(F.lit("="), "session"), F.concat(F.lit("#"), F.col("row_id").cast("string")))
    df = df.select("source", own.alias("session"), F.col("place").cast("long").alias("place"), "row_id", "readings", wanted.alias("wanted"))
    valid = write_once(df, "readings").where(F.size("readings") > 0)
    several = F.size("readings") > 1
    sure = valid.where(~several & F.col("wanted")).select("source", "row_id", F.col("readings")[0]["us"].alias("epoch_us"))
    unsure_sessions = valid.where(several).select("source", "session").distinct()
    rows = valid.join(unsure_sessions, ["source", "session"], "left_semi").select(
        "*", F.coalesce(F.floor(F.col("place") / BLOCK), F.lit(-1)).alias("block"), (~several).alias("sure")
    )
    fixed = F.when(F.col("sure"), F.struct("place", "row_id", F.col("readings")[0]["us"].alias("us"), F.col("readings")[0]["form"].alias("form")))
    inside = Window.partitionBy("source", "session", "block").orderBy("place", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source", "session", "block").agg(F.max(fixed).alias("last"))
    upto = Window.partitionBy("source", "session").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("source", "session", "block", F.last("last", True).over(upto).alias("carried"))
    # Besides the unsure rows, the sure ones right behind them, which end a stretch and count for its costs.
    order = Window.partitionBy("source", "session", "block").orderBy("place", "row_id")
    ends = ~F.coalesce(F.lag("sure").over(order), F.lit(False))
    known = rows.withColumn("near", F.last(fixed, True).over(inside)).withColumn("_ends", ends).where(~F.col("sure") | F.col("_ends"))
    known = known.join(carried, ["source", "session", "block"])
    islands = known.select(
        "source", "session", "place", "row_id", "readings", "sure", F.coalesce("near", "carried").alias("before")
    ).select("*", F.col("before.us").alias("before_us"), F.col("before.form").alias("before_form"), F.xxhash64("source", "session", "before").alias("island"))
    walked = (
        islands.select("island", "source", "session", "place", "row_id", "readings", "sure", "before_us", "before_form")
        .repartition("island")
        .sortWithinPartitions("island", "source", "session", "before_us", "place", "row_id")
        .mapInArrow(_walk, "source string, row_id long, epoch_us long")
    )
    return sure.unionByName(walked)


def step_costs(choices: list[tuple[int, str]], before: tuple[int, str] | None) -> list[float]:
    """What each reading of a row costs after a reading of the row before."""
    floor = None if before is None or before[0] is None else before[0] // MINUTE
    forms: dict[str, list[int]] = {}
    for i, (_, form) in enumerate(choices):
        forms.setdefault(form, []).append(i)
    costs = [0.0] * len(choices)
    for form, own in forms.items():
        best = next((n for n, i in enumerate(own) if floor is None or choices[i][0] // MINUTE >= floor), len(own) - 1)
        for n, i in enumerate(own):
            costs[i] = abs(n - best) + (SWITCH if before and before[1] not in (None, form) else 0.0)
            if floor is not None and choices[i][0] // MINUTE < floor and len(forms) > 1:
                costs[i] += 1.0
    return costs


class Viterbi:
    """Path of least cost, given out as soon as all paths still open agree."""

    def __init__(self, before_us: int | None, before_form: str | None = None):
        self.before: list[tuple[int | None, str | None]] = [(before_us, before_form)] if before_us is not None else []
        self.cost = [0.0] if self.before else []
        self.waiting: list[tuple[tuple, list[tuple[int, str]], list[int]]] = []
        #: How many rows wait before it is looked whether paths agree: twice as many as were left, so that looking stays linear.
        self.look = 16

    def add(self, key: tuple, choices: list[tuple[int, str]]) -> list[tuple[tuple, int]]:
        if not self.before:
            cost, back = step_costs(choices, None), [0] * len(choices)
        else:
            table_ = [[c + s for s in step_costs(choices, b)] for b, c in zip(self.before, self.cost)]
            back = [min(range(len(table_)), key=lambda r: (table_[r][i], r)) for i in range(len(choices))]
            cost = [table_[back[i]][i] for i in range(len(choices))]
        low = min(cost)
        self.waiting.append((key, choices, back))
        self.before, self.cost = list(choices), [c - low for c in cost]
        if len(self.waiting) < self.look:
            return []
        heads = set(range(len(choices)))
        for n in range(len(self.waiting) - 1, 0, -1):
            heads = {self.waiting[n][2][h] for h in heads}
            if len(heads) == 1:
                given = self._give(n, heads.pop())
                self.look = max(16, 2 * len(self.waiting))
                return given
        self.look = 2 * len(self.waiting)
        return []

    def _give(self, upto: int, head: int) -> list[tuple[tuple, int]]:
        out = []
        for key, choices, back in reversed(self.waiting[:upto]):
            out.append((key, choices[head][0]))
            head = back[head]
        del self.waiting[:upto]
        return out[::-1]

    def close(self) -> list[tuple[tuple, int]]:
        if not self.waiting:
            return []
        head = min(range(len(self.cost)), key=lambda i: (self.cost[i], i))
        return self._give(len(self.waiting), head)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, path = None, None

    def out(settled: list[tuple[tuple, int]]) -> pa.RecordBatch:
        settled = [(k, us) for k, us in settled if k is not None]
        columns = [[k[0] for k, _ in settled], [k[1] for k, _ in settled], [us for _, us in settled]]
        types = [pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["source", "row_id", "epoch_us"])

    for batch in batches:
        settled: list[tuple[tuple, int]] = []
        for r in batch.to_pylist():
            key = (r["source"], r["session"], r["before_us"], r["island"])
            if key != current:
                settled += path.close() if path else []
                current, path = key, Viterbi(r["before_us"], r["before_form"])
            # Rows with one reading are given out elsewhere.
            settled += path.add(None if r["sure"] else (r["source"], r["row_id"]), [(c["us"], c["form"]) for c in r["readings"]])
        yield out(settled)
    if path:
        yield out(path.close())


def session_records(spark, sf_dir: str) -> DataFrame:
    """The rows of the three message tables as (source, row_id, session, place, raw, zone)."""
    places = table(spark, sf_dir, "workspaces").where(F.col("client_tz").isin(*ts.known_zones()))
    places = small(places.groupBy("cwd").agg(F.min("client_tz").alias("zone")))
    hermes = table(spark, sf_dir, "hermes_messages").select(
        F.lit("hermes").alias("source"), "row_id", F.col("session_id").alias("session"), F.col("seq").alias("place"), F.col("timestamp").alias("raw")
    )
    sessions = table(spark, sf_dir, "hermes_sessions").groupBy(F.col("id").alias("session")).agg(F.min("cwd").alias("cwd"))
    hermes = hermes.join(sessions.join(places, "cwd").select("session", "zone"), "session", "left")
    records = table(spark, sf_dir, "codex_records")
    codex = records.select(
        F.lit("codex").alias("source"), "row_id", F.col("file").alias("session"), F.col("line_no").alias("place"), F.col("timestamp").alias("raw")
    )
    meta = records.where((F.lower(F.trim("type")) == "session_meta") & F.col("payload.cwd").isNotNull())
    meta = meta.groupBy(F.col("file").alias("session")).agg(F.min_by("payload.cwd", "line_no").alias("cwd"))
    codex = codex.join(meta.join(places, "cwd").select("session", "zone"), "session", "left")
    grok = table(spark, sf_dir, "grok_records").select(
        F.lit("grok").alias("source"),
        "row_id",
        F.col("params.sessionId").alias("session"),
        F.col("line_no").alias("place"),
        F.col("timestamp").alias("raw"),
        "cwd",
    )
    grok = grok.join(places, "cwd", "left").drop("cwd")
    return hermes.unionByName(codex).unionByName(grok)


def zone_abbreviations(spark, sf_dir: str) -> dict[str, int]:
    """"ZONE|ABBR" → seconds, of the zones in use (at most as many as there are zones)."""
    used = table(spark, sf_dir, "workspaces").where(F.col("client_tz").isin(*ts.known_zones())).select("client_tz").distinct()
    return {f"{z.client_tz}|{a}": s for z in used.collect() for a, s in ts.abbreviations(z.client_tz).items()}


def instants(spark, sf_dir: str) -> DataFrame:
    """All rows of the message tables whose timestamp denotes a time: (source, row_id, epoch_us)."""
    read = readings(session_records(spark, sf_dir), "raw", F.col("zone"), zone_abbreviations(spark, sf_dir))
    return settle(read)
