"""Queries of dialogue sources and of evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions.text import WHITE_SPACE, is_blank, word
from loomstead.functions.timestamps import STORED_INSTANT_SQL, stored_instant
from loomstead.operators import dialogue, evaluation
from loomstead.plans import views
from loomstead.plans.registry import query
from loomstead.session import table

_WS = "'" + WHITE_SPACE + "'"
_US = STORED_INSTANT_SQL.replace("{s}", f'trim("timestamp", {_WS})')
_HERMES = f"""m as (select session_id as session, seq as place, lower(trim(role, {_WS})) as role, content as text, {_US} as us, row_id from hermes_messages
   where lower(trim(role, {_WS})) in ('user', 'assistant') and content is not null and trim(content, {_WS}) <> ''
   qualify row_number() over (partition by session_id, seq order by row_id) = 1)"""


def hermes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible messages of the exported sessions; of rows at one place the first counts."""
    m = table(spark, sf_dir, "hermes_messages").select(
        F.col("session_id").alias("session"), F.col("seq").alias("place"), word(F.col("role")).alias("role"), F.col("content").alias("text"), F.timestamp_micros(stored_instant(F.col("timestamp"))).alias("ts"), "row_id"
    )
    m = m.where(F.col("role").isin("user", "assistant") & ~is_blank(F.col("text")))
    order = Window.partitionBy("session", "place").orderBy("row_id")
    return m.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


@query(
    f"with {_HERMES} select session, string_agg(upper(role) || ' [' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || case when us % 1000000 <> 0 then '.' || lpad((us % 1000000)::varchar, 6, '0') else '' end || 'Z]' || chr(10) || text, "
    "chr(10) || chr(10) order by place) as text, max(us) as ts_us, count(*) as message_count from m where us is not null group by 1"
)
def dialogue_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each session, of its messages with a time."""
    return dialogue.render(hermes(spark, sf_dir)).select("session", "text", F.unix_micros("ts").alias("ts_us"), "message_count")


_GROK = f"""g as (select params.sessionId as session, line_no as place, case when k = 'user_message_chunk' then 'user' when k = 'agent_message_chunk' then 'assistant' else 'end' end as kind,
   params.update.content as text, {_US} as us from (select *, lower(trim(params.update.sessionUpdate, {_WS})) as k from grok_records)
   where k in ('user_message_chunk', 'agent_message_chunk', 'turn_completed')
   qualify row_number() over (partition by params.sessionId, line_no order by row_id) = 1)"""


def grok(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("params.update")
    k = word(u["sessionUpdate"])
    g = table(spark, sf_dir, "grok_records").where(k.isin("user_message_chunk", "agent_message_chunk", "turn_completed"))
    kind = F.when(k == "user_message_chunk", "user").when(k == "agent_message_chunk", "assistant").otherwise("end")
    g = g.select(F.col("params.sessionId").alias("session"), F.col("line_no").alias("place"), kind.alias("kind"), u["content"].alias("text"), stored_instant(F.col("timestamp")).alias("ts"), "row_id")
    order = Window.partitionBy("session", "place").orderBy("row_id")
    return g.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


@query(
    f"""with {_GROK}, s as (select *, case when lag(kind) over (partition by session order by place) is distinct from kind then 1 else 0 end as st from g),
 r as (select *, sum(st) over (partition by session order by place) as run from s)
 select session, run::bigint as run, kind as role, coalesce(string_agg(text, '' order by place), '') as text, max(us) as ts_us from r where kind <> 'end' group by session, run, kind"""
)
def role_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed chunks as whole messages."""
    return dialogue.role_runs(grok(spark, sf_dir)).select("session", "run", "role", "text", F.col("ts").alias("ts_us"))


_CODEX = f"""c as (select file as unit, line_no, row_id, 0 as channel, lower(trim(payload.role, {_WS})) as role from codex_records
   where lower(trim(type, {_WS})) = 'response_item' and lower(trim(payload.type, {_WS})) = 'message' and lower(trim(payload.role, {_WS})) in ('user', 'assistant')
 union all select file, line_no, row_id, 1, case when lower(trim(payload.type, {_WS})) = 'user_message' then 'user' else 'assistant' end from codex_records
   where lower(trim(type, {_WS})) = 'event_msg' and lower(trim(payload.type, {_WS})) in ('user_message', 'agent_message'))"""


@query(f"with {_CODEX} select unit, line_no, row_id, channel, role from c qualify channel = min(channel) over (partition by unit)")
def canonical_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each file's first channel that has any."""
    p, kind = F.col("payload"), word(F.col("type"))
    sort, role = word(p["type"]), word(p["role"])
    channel = F.when((kind == "response_item") & (sort == "message") & role.isin("user", "assistant"), 0).when(
        (kind == "event_msg") & sort.isin("user_message", "agent_message"), 1
    )
    said = F.when(channel == 0, role).when(sort == "user_message", "user").otherwise("assistant")
    rows = table(spark, sf_dir, "codex_records").select(F.col("file").alias("unit"), "line_no", "row_id", channel.alias("channel"), said.alias("role"))
    return dialogue.canonical(rows.where("channel is not null"))


@query(
    """with m as (select file, arg_min(payload.id, line_no) as meta_id, arg_min(payload.cwd, line_no) as cwd from codex_records where lower(trim(type)) = 'session_meta' and payload.id is not null group by 1),
 f as (select file, count(*) as records, count(*) filter (payload is null) as malformed, max(line_no) as last_line from codex_records group by 1)
 select 'grok' as source, params.sessionId as file, 'session:' || params.sessionId as source_key, nullif(regexp_replace(min(cwd), '^.*[/\\\\]', ''), '') as project,
   count(*) as records, count(*) filter (params.update is null) as malformed, max(line_no) as last_line from grok_records where params.sessionId is not null group by params.sessionId
 union all select 'hermes', session_id, 'session:' || session_id, nullif(regexp_replace(min(cwd), '^.*[/\\\\]', ''), ''), count(*), count(*) filter (role is null), max(seq)
   from hermes_messages left join (select id, min(cwd) as cwd from hermes_sessions group by 1) on id = session_id where session_id is not null group by session_id
 union all select 'codex', file, 'session:' || coalesce(meta_id, regexp_replace(regexp_replace(file, '^.*[/\\\\]', ''), '\\.jsonl$', '')) as source_key,
   nullif(regexp_replace(cwd, '^.*[/\\\\]', ''), '') as project, records, malformed, last_line from f left join m using (file)"""
)
def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, project and record counts of each session of the three tables."""
    name = lambda c: F.nullif(F.regexp_replace(c, r"^.*[/\\]", ""), F.lit(""))
    counts = lambda bad, place: [F.count("*").alias("records"), F.count_if(bad).alias("malformed"), F.max(place).alias("last_line")]
    g = table(spark, sf_dir, "grok_records").where("params.sessionId is not null").groupBy(F.col("params.sessionId").alias("file"))
    g = g.agg(F.min("cwd").alias("cwd"), *counts(F.col("params.update").isNull(), "line_no")).withColumn("source", F.lit("grok"))
    known = table(spark, sf_dir, "hermes_sessions").groupBy(F.col("id").alias("file")).agg(F.min("cwd").alias("cwd"))
    h = table(spark, sf_dir, "hermes_messages").where("session_id is not null").groupBy(F.col("session_id").alias("file"))
    h = h.agg(*counts(F.col("role").isNull(), "seq")).join(known, "file", "left").withColumn("source", F.lit("hermes"))
    others = g.unionByName(h).select("source", "file", F.concat(F.lit("session:"), "file").alias("source_key"), name(F.col("cwd")).alias("project"), "records", "malformed", "last_line")
    c = table(spark, sf_dir, "codex_records")
    meta = c.where((F.lower(F.trim("type")) == "session_meta") & F.col("payload.id").isNotNull()).groupBy("file").agg(
        F.min_by("payload.id", "line_no").alias("meta_id"), F.min_by("payload.cwd", "line_no").alias("cwd")
    )
    files = c.groupBy("file").agg(F.count("*").alias("records"), F.count_if(F.col("payload").isNull()).alias("malformed"), F.max("line_no").alias("last_line"))
    stem = F.regexp_replace(F.regexp_replace("file", r"^.*[/\\]", ""), r"\.jsonl$", "")
    project = F.nullif(F.regexp_replace("cwd", r"^.*[/\\]", ""), F.lit(""))
    own = files.join(meta, "file", "left").select(
        F.lit("codex").alias("source"), "file", F.concat(F.lit("session:"), F.coalesce("meta_id", stem)).alias("source_key"), project.alias("project"), "records", "malformed", "last_line"
    )
    return others.unionByName(own)


@query(
    f"select lower(trim(source, {_WS})) as source, trim(source_key, {_WS}) as source_key, arg_max(row_id, (coalesce(epoch_us(\"timestamp\"), -9223372036854775807), row_id)) as row_id from ingest_documents group by 1, 2"
)
def dedupe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's deliveries the latest."""
    d = table(spark, sf_dir, "ingest_documents").select(word(F.col("source")).alias("source"), F.btrim("source_key", F.lit(WHITE_SPACE)).alias("source_key"), "row_id", "timestamp")
    return dialogue.latest_of_key(d, ["source", "source_key"], F.col("timestamp"), F.col("row_id")).select("source", "source_key", "row_id")


@query(
    f"with {views.DOCS} select source, count(*) filter (ts >= timestamptz '{views.NOW}+00' - interval 90 day) as inside, count(*) filter (ts < timestamptz '{views.NOW}+00' - interval 90 day) as outside, epoch_us(max(ts)) as watermark_us from docs group by 1"
)
def rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents inside and outside of the last 90 days, and each source's watermark."""
    cutoff = F.to_timestamp(F.lit(views.NOW)) - F.expr("interval 90 days")
    return views.docs(spark, sf_dir).groupBy("source").agg(
        F.count_if(F.col("ts") >= cutoff).alias("inside"), F.count_if(F.col("ts") < cutoff).alias("outside"), F.unix_micros(F.max("ts")).alias("watermark_us")
    )


_EVENTS = """e as (select user_id as session, ts, event_id as place from events),
 g as (select *, sum(case when ts - p > interval 30 minute then 1 else 0 end) over (partition by session order by ts, place) as sitting from (select *, lag(ts) over (partition by session order by ts, place) as p from e)),
 u as (select *, (row_number() over (partition by session, sitting order by ts, place) - 1) // 12 as unit from g)"""


@query(f"with {_EVENTS} select session, place as event_id, dense_rank() over (partition by session order by sitting, unit) - 1 as segment from u")
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each user's events: a pause of more than 30 minutes or 12 events end one."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("place"))
    return dialogue.segments(e).select("session", F.col("place").alias("event_id"), "segment")


_UNITS = f"{_HERMES}, n as (select session, place, row_number() over (partition by session order by place) - 1 as ordinal from m), units as (select session, ordinal // 12 as unit, min(ordinal) as first_ordinal, max(ordinal) as last_ordinal from n group by 1, 2)"


@query(f"with {_UNITS} select u.session, u.unit, n.ordinal, n.place from units u join n on n.session = u.session and n.ordinal between u.first_ordinal and u.last_ordinal")
def unit_to_chunk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages in the range of each unit."""
    order = Window.partitionBy("session").orderBy("place")
    n = hermes(spark, sf_dir).select("session", "place", (F.row_number().over(order) - 1).alias("ordinal"))
    units = n.groupBy("session", F.floor(F.col("ordinal") / 12).alias("unit")).agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))
    return units.join(n, "session").where("ordinal between first_ordinal and last_ordinal").select("session", "unit", "ordinal", "place")


_RANKING = f"""{views.BM25}, per as (select query_id, document_id, max(round(score, 9)) as score from scores join chunks using (chunk_pk) group by all),
 ranking as (select query_id::int as query_id, document_id, row_number() over (partition by query_id order by score desc, document_id) as position from per qualify position <= 20),
 judged as (select q.query_id, document_id, case when kind = 'note' then 2.0 when kind = 'summary' then 1.5 else 1.0 end::double as gain from docs,
   (values (1, 'stale lease'), (2, 'shared footer'), (3, 'migration runner'), (4, 'verrou')) q(query_id, word) where contains(lower("text"), word) and ts >= timestamptz '2026-06-01 00:00:00+00')"""


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = views.indexed(spark, sf_dir)
    scores = built.bm25(views.queries(spark)).withColumn("score", F.round("score", 9))
    per = scores.join(built.chunks.select("chunk_pk", "document_id"), "chunk_pk").groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    return per.withColumn("position", F.row_number().over(order)).where("position <= 20").select("query_id", "document_id", "position")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents of each query, as the SQL judges: those that hold its word and are dated 2026-06-01 or later.

    Older and undated documents count as not relevant, though the ranking is over all documents.
    """
    words = spark.createDataFrame([(1, "stale lease"), (2, "shared footer"), (3, "migration runner"), (4, "verrou")], "query_id int, word string")
    gain = F.when(F.col("kind") == "note", 2.0).when(F.col("kind") == "summary", 1.5).otherwise(1.0)
    d = views.docs(spark, sf_dir).where(F.col("ts") >= F.to_timestamp(F.lit("2026-06-01 00:00:00")))
    return d.join(F.broadcast(words), F.contains(F.lower("text"), F.col("word"))).select("query_id", "document_id", gain.alias("gain"))


_CASES = f"""{_RANKING}, hit as (select query_id, position, gain from ranking join judged using (query_id, document_id)),
 got as (select query_id, count(*) filter (position <= 8) as in8, count(*) filter (position <= 20) as in20, min(position) as fst, sum(case when position <= 10 then gain / log2(position + 1) end) as dcg from hit group by 1),
 ideal as (select query_id, count(*) as relevant, sum(case when n <= 10 then gain / log2(n + 1) end) as idcg from (select *, row_number() over (partition by query_id order by gain desc, document_id) as n from judged) group by 1),
 cases as (select query_id, coalesce(in8 / relevant, 0)::double as recall_at_8, coalesce(in20 / relevant, 0)::double as recall_at_20, case when fst <= 8 then 1.0::double / fst else 0 end as mrr_at_8, coalesce(dcg / idcg, 0) as ndcg_at_10
   from (select distinct query_id from (select query_id from ranking union all select query_id from judged)) left join ideal using (query_id) left join got using (query_id))"""


@query(f"with {_CASES} select query_id, round(recall_at_8, 6) as recall_at_8, round(recall_at_20, 6) as recall_at_20, round(mrr_at_8, 6) as mrr_at_8, round(ndcg_at_10, 6) as ndcg_at_10 from cases")
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each query's ranking."""
    cases = evaluation.case_metrics(_ranking(spark, sf_dir), _judged(spark, sf_dir))
    return cases.select("query_id", *(F.round(m, 6).alias(m) for m in evaluation.FLOORS))


_MEANS = f"""{_CASES}, means as (select 'recall_at_8' as metric, round(avg(recall_at_8), 6) as value from cases union all select 'recall_at_20', round(avg(recall_at_20), 6) from cases
 union all select 'mrr_at_8', round(avg(mrr_at_8), 6) from cases union all select 'ndcg_at_10', round(avg(ndcg_at_10), 6) from cases)"""


@query(f"with {_MEANS} select metric, value, floor, value < floor as broken from means join (values ('recall_at_8', 1.0), ('recall_at_20', 1.0), ('mrr_at_8', 0.78), ('ndcg_at_10', 0.83)) f(metric, floor) using (metric)")
def floors_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics are below their floors."""
    return evaluation.floors(evaluation.means(evaluation.case_metrics(_ranking(spark, sf_dir), _judged(spark, sf_dir))))


@query(f"with {_MEANS} select metric, value, was, value - was < -1e-6 as regressed from means join (values ('recall_at_8', 0.01), ('recall_at_20', 0.5), ('mrr_at_8', 0.2), ('ndcg_at_10', 0.9)) f(metric, was) using (metric)")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metrics fell against a recorded run."""
    measured = evaluation.means(evaluation.case_metrics(_ranking(spark, sf_dir), _judged(spark, sf_dir)))
    was = spark.createDataFrame([("recall_at_8", 0.01), ("recall_at_20", 0.5), ("mrr_at_8", 0.2), ("ndcg_at_10", 0.9)], "metric string, value double")
    return evaluation.gate(measured, was)


@query("select event_type, quantile_disc(value, 0.95) as p95, median(value) as p50 from events group by 1")
def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank 95th percentile and median of each kind of event."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.nearest_rank("value", 0.95).alias("p95"), F.median("value").alias("p50"))


@query(
    f"""with {_RANKING}, written(query_id, word, forbidden_source, most_ms, latency_ms) as (values (1, 'stale lease', 'none', 1500, 900), (2, 'shared footer', 'none', 1500, 1600), (3, 'migration runner', 'codex', 1500, 20), (4, 'no such words', 'none', 1500, 20)),
 expected as (select w.*, (select min(document_id) from docs d where contains(lower(d."text"), word)) as document_id, (select max(document_id) from docs d where contains(lower(d."text"), word)) as forbidden_document, 1 as baseline_rank, 2 as rank_tolerance, query_id = 4 as expected_empty from written w),
 counted as (select query_id, count(*) as n, count(distinct document_id) as nd, list(distinct source) as sources, list(distinct document_id) as documents, list(distinct project) filter (project is not null) as projects from ranking join docs using (document_id) group by 1)
 select e.query_id, array_to_string(list_filter([case when expected_empty and coalesce(n, 0) > 0 then 'expected_empty' end,
   case when e.document_id is not null and r.position is null then 'expected_document_missing' end, case when r.position - baseline_rank > rank_tolerance then 'rank_regression' end,
   case when list_contains(sources, forbidden_source) then 'forbidden_source_returned' end, case when coalesce(n, 0) <> coalesce(nd, 0) then 'duplicate_documents' end,
   case when list_contains(documents, forbidden_document) then 'forbidden_document_returned' end, case when len(list_filter(projects, lambda x: x <> 'harbor-console')) > 0 then 'project_leak' end,
   case when latency_ms > most_ms then 'latency_exceeded' end], lambda x: x is not null), ',') as failures
 from expected e left join ranking r on r.query_id = e.query_id and r.document_id = e.document_id left join counted w on w.query_id = e.query_id"""
)
def canary_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each canary finds wrong; what is expected comes from the texts, not from the ranking."""
    of_document = views.indexed(spark, sf_dir).chunks.select("document_id", "source", "project").distinct()
    ranking = _ranking(spark, sf_dir).join(of_document, "document_id")
    ranking = ranking.withColumns({"citation": F.concat(F.lit(evaluation.CITATION), "document_id"), "taints": F.array(F.lit("untrusted_evidence"))})
    written = [(1, "stale lease", "none", 1500, 900), (2, "shared footer", "none", 1500, 1600), (3, "migration runner", "codex", 1500, 20), (4, "no such words", "none", 1500, 20)]
    cases = spark.createDataFrame(written, "query_id int, word string, forbidden_source string, most_ms int, latency_ms int")
    held = views.docs(spark, sf_dir).select("document_id", F.lower("text").alias("text")).join(F.broadcast(cases.select("query_id", "word")), F.contains("text", F.col("word")))
    ends = held.groupBy("query_id").agg(F.min("document_id").alias("document_id"), F.max("document_id").alias("forbidden_document"))
    expected = cases.drop("word").join(ends, "query_id", "left").withColumns(
        {"baseline_rank": F.lit(1), "rank_tolerance": F.lit(2), "expected_empty": F.col("query_id") == 4, "project": F.lit("harbor-console")}
    )
    return evaluation.canary_failures(expected, ranking)


@query(
    f"""with {views.DOCS}, r as (select *, row_number() over (partition by source, project order by ts desc nulls last, doc_id) as round from docs)
 select source, project, doc_id, row_number() over (partition by source order by round, project nulls first, doc_id) as place from r qualify place <= 50"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents of each source, taken from its projects in turn."""
    # Of a project no more than fifty rounds can be among a source's first fifty, so each task ranks no more.
    inner = Window.partitionBy("source", "project").orderBy(F.desc_nulls_last("ts"), "doc_id")
    outer = Window.partitionBy("source").orderBy("round", F.asc_nulls_first("project"), "doc_id")
    d = views.docs(spark, sf_dir).select("source", "project", "doc_id", "ts").withColumn("round", F.row_number().over(inner)).where("round <= 50")
    return d.withColumn("place", F.row_number().over(outer)).where("place <= 50").select("source", "project", "doc_id", "place")


@query(
    """with v as (select c.*, len(embedding) as n from chunk_vectors c)
 select embedding_model, count(*) as vectors, count(*) filter (embedding is null) as missing, count(*) filter (n <> embedding_dimensions) as wrong_dims,
  count(*) filter (document_id not in (select document_id from stored_documents)) as orphans, count(*) filter (ordinal < 0) as bad_ordinals,
  count(*) - count(distinct (document_id, ordinal)) as repeated_places from v group by 1"""
)
def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors break which rule."""
    held = table(spark, sf_dir, "stored_documents").select("document_id", F.lit(True).alias("_held")).distinct()
    v = table(spark, sf_dir, "chunk_vectors").join(held, "document_id", "left")
    return v.groupBy("embedding_model").agg(
        F.count("*").alias("vectors"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
        F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") != F.col("embedding_dimensions"))).alias("wrong_dims"),
        F.count_if(F.col("_held").isNull()).alias("orphans"),
        F.count_if(F.col("ordinal") < 0).alias("bad_ordinals"),
        (F.count("*") - F.countDistinct("document_id", "ordinal")).alias("repeated_places"),
    )
