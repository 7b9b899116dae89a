"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions import timestamps as ts
from loomstead.functions.text import WHITE_SPACE, strip, word
from loomstead.operators import incremental, timeline
from loomstead.plans.registry import query
from loomstead.session import table, temporary


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of each row whose timestamp isn't already in the plain UTC form."""
    rows = timeline.session_records(spark, sf_dir)
    read = timeline.readings(rows, "raw", F.col("zone"), timeline.zone_abbreviations(spark, sf_dir))
    return timeline.settle(read, wanted=~F.col("raw").rlike(ts.CANONICAL))


P5_SQL = r"""
with docs as (
  select row_id, lower(trim(source, {ws})) as source, trim(source_key, {ws}) as source_key, trim(text, {ws}) as body,
         "timestamp" as ts, run_id from ingest_documents),
last as (
  select lower(trim(source, {ws})) as source, max(started_at) as last_start from scan_runs
  where successful and watermark is not null group by 1),
starts as (select run_id, max(started_at) as started from scan_runs where started_at is not null group by 1),
latest as (
  select d.*, row_number() over (partition by d.source, d.source_key order by d.ts desc nulls last, d.row_id desc) as n
  from docs d join starts s using (run_id) left join last l on d.source = l.source
  where l.last_start is null or s.started > l.last_start),
stored as (
  select lower(trim(source, {ws})) as source, trim(source_key, {ws}) as source_key,
         regexp_replace(lower(trim(content_hash, {ws})), '^sha256:', '') as known from stored_documents)
select v.row_id from latest v left join stored s on v.source = s.source and v.source_key = s.source_key
where n = 1 and body is not null and body <> '' and sha256(body) is distinct from s.known
""".replace("{ws}", "'" + WHITE_SPACE + "'")


@query(P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents new or changed since their source's last successful run, and not held by the store already.

    The state begins as what the store holds; it moves on when a consumer has processed the rows (see p5_runs).
    """
    state = incremental.stored_state(spark, sf_dir, temporary(spark, "state"))
    return incremental.pending_documents(spark, sf_dir, state).select("row_id")


#: Deliveries before the first time make the first run, those before the second the second, the others the third.
RUN_ENDS = ("2026-07-06 00:00:00", "2026-07-14 00:00:00")
P5_RUNS_SQL = rf"""
with docs as (
  select row_id, lower(trim(source, {{ws}})) as source, trim(source_key, {{ws}}) as source_key, trim(text, {{ws}}) as body, "timestamp" as ts,
    case when delivered_at < timestamptz '{RUN_ENDS[0]}+00' then 1 when delivered_at < timestamptz '{RUN_ENDS[1]}+00' then 2 else 3 end as run
  from ingest_documents where delivered_at is not null),
latest as (select * from docs qualify row_number() over (partition by run, source, source_key order by ts desc nulls last, row_id desc) = 1),
hashed as (select run, source, source_key, row_id, sha256(body) as h from latest where body is not null and body <> '')
select run, row_id from (select *, lag(h) over (partition by source, source_key order by run) as was from hashed) where h is distinct from was
""".replace("{ws}", "'" + WHITE_SPACE + "'")


@query(P5_RUNS_SQL)
def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three runs over one state hands out; the second fails after processing and is taken up by the third."""
    state = incremental.KeyHashState(spark, temporary(spark, "state"), ["source", "source_key"])
    out = temporary(spark, "runs")
    docs = table(spark, sf_dir, "ingest_documents").select(
        "row_id", word(F.col("source")).alias("source"), strip(F.col("source_key")).alias("source_key"), "text", "timestamp", "delivered_at"
    )
    first, second = (F.to_timestamp(F.lit(t)) for t in RUN_ENDS)
    at = F.col("delivered_at")
    for number, part in enumerate((at < first, (at >= first) & (at < second), at >= second), 1):
        rows = incremental.latest_versions(docs.where(part)).where(~F.col("blank"))

        def process(handed: DataFrame, run: int, crash: bool = number == 2) -> None:
            incremental.append_once(out)(handed, run)
            if crash:
                raise InterruptedError("lost before the state moved on")

        try:
            state.run(rows, process)
        except InterruptedError:
            pass
    return spark.read.parquet(out).select(F.col("batch").cast("int").alias("run"), "row_id")
