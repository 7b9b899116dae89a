"""Queries of metadata, memories, provenance lookups, scopes and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import redact
from loomstead.functions.text import WHITE_SPACE, sha, stable_id, strip, word
from loomstead.functions.timestamps import STORED_INSTANT_SQL, stored_instant
from loomstead.operators import distill
from loomstead.plans import dialogue_queries, store_queries, views
from loomstead.plans.registry import query
from loomstead.session import table
from loomstead.sources import jsonl
from loomstead.sources.projects import SECRET_NAMES, SECRET_WORDS, looks_secret

_WS = "'" + WHITE_SPACE + "'"


@query(
    f"select row_id, coalesce(array_to_string(list_sort(list_transform(map_entries(metadata), lambda e: {store_queries.sql_redacted('e.key')} || '=' || coalesce({store_queries.sql_redacted('e.value')}, ''))), ';'), '') as metadata from ingest_documents"
)
def redact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of each delivery without secrets, as sorted pairs."""
    # Keys that are alike without their secrets stay two, which a map couldn't hold.
    clean = lambda e: F.concat(redact.redact(e["key"]), F.lit("="), F.coalesce(redact.redact(e["value"]), F.lit("")))
    pairs = F.array_sort(F.transform(F.map_entries("metadata"), clean))
    return table(spark, sf_dir, "ingest_documents").select("row_id", F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("metadata"))


@query(
    f"with {views.CHUNKS} select chunk_pk, case when coalesce(project, '') <> '' then c.title || ' › ' || project || chr(10) || chr(10) || content else content end as embedded, "
    "sha256(case when coalesce(project, '') <> '' then c.title || ' › ' || project || chr(10) || chr(10) || content else content end) as input_hash from chunks c join (select doc_id, project from docs) using (doc_id)"
)
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each chunk: its text under title and breadcrumb, if it has one."""
    c = views.chunks(spark, sf_dir).join(views.docs(spark, sf_dir).select("doc_id", "project"), "doc_id")
    text = F.when(F.coalesce("project", F.lit("")) != "", F.concat("title", F.lit(" › "), "project", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    return c.select("chunk_pk", text.alias("embedded"), F.sha2(text, 256).alias("input_hash"))


@query(
    f"with {store_queries._RECEIPTS} select artifact, receipt_id from receipts where superseded_at is null "
    "qualify row_number() over (partition by artifact order by created_at desc nulls last, receipt_id desc) = 1"
)
def active_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The receipt in force of each document."""
    r = store_queries._receipts(spark, sf_dir).where("superseded_at is null")
    return r.groupBy("artifact").agg(F.max_by("receipt_id", F.struct("created_at", "receipt_id")).alias("receipt_id"))


@query(
    f"with {store_queries._VERSIONS}, m as (select content_hash, min(row_id) as row_id, count(*) as deliveries from versions where kind = 'memory' group by 1) "
    "select 'mem_' || substr(content_hash, 1, 32) as source_key, row_id, deliveries from m"
)
def save_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories by their content: the same note twice is one."""
    v = store_queries.versions(spark, sf_dir).where("kind = 'memory'")
    m = v.groupBy("content_hash").agg(F.min("row_id").alias("row_id"), F.count("*").alias("deliveries"))
    return m.select(F.concat(F.lit("mem_"), F.substring("content_hash", 1, 32)).alias("source_key"), "row_id", "deliveries")


@query(
    f"with {store_queries._VERSIONS} select s.source, s.source_key from stored s where not (s.source = 'memory' and s.source_key in "
    "(select source_key from versions where kind = 'memory' and length(body) < 200))"
)
def forget_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store without some memories; documents of other kinds can't be forgotten this way."""
    gone = store_queries.versions(spark, sf_dir).where("kind = 'memory' and length(body) < 200").select(F.lit("memory").alias("source"), "source_key")
    return store_queries.stored(spark, sf_dir).join(gone, ["source", "source_key"], "left_anti").select("source", "source_key")


@query(
    "with d as (select count(*) as documents from stored_documents), c as (select count(*) as chunks, count(distinct (document_id, ordinal)) as receipts from chunk_vectors "
    "where document_id in (select document_id from stored_documents)) select documents, chunks, receipts + documents as receipts, receipts + documents < documents + chunks as backfill from d, c"
)
def provenance_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document and chunk has a receipt."""
    held = table(spark, sf_dir, "stored_documents").select("document_id")
    own = table(spark, sf_dir, "chunk_vectors").select("document_id", "ordinal").join(held, "document_id", "left_semi")
    c = own.agg(F.count("*").alias("chunks"), F.countDistinct("document_id", "ordinal").alias("r"))
    d = held.agg(F.count("*").alias("documents"))
    # One row each.
    return d.crossJoin(F.broadcast(c)).select(
        "documents", "chunks", (F.col("r") + F.col("documents")).alias("receipts"), (F.col("r") < F.col("chunks")).alias("backfill")
    )


@query(
    f"with {dialogue_queries._RANKING}, g as (select query_id, string_agg(document_id || ':' || gain::decimal(4,1)::varchar, ',' order by document_id) as labels, count(*) as relevant from judged where gain > 0 group by 1) "
    "select query_id, relevant, sha256(query_id || chr(0) || labels) as fingerprint from g"
)
def label_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each query's labels, by which runs are known to be comparable."""
    one = F.concat("document_id", F.lit(":"), F.col("gain").cast("decimal(4,1)").cast("string"))
    labels = dialogue_queries._judged(spark, sf_dir).where("gain > 0").groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    return labels.select("query_id", F.size("l").cast("long").alias("relevant"), sha(F.col("query_id").cast("string"), F.array_join("l", ",")).alias("fingerprint"))


_STAMP = STORED_INSTANT_SQL.replace("{s}", "s")


@query(
    f"with r as (select 'hermes' as source, row_id, trim(\"timestamp\", {_WS}) as s from hermes_messages union all select 'codex', row_id, trim(\"timestamp\", {_WS}) from codex_records "
    f"union all select 'grok', row_id, trim(\"timestamp\", {_WS}) from grok_records) select source, row_id, coalesce({_STAMP}, 0) as epoch_us from r"
)
def simple_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps as the store reads them: ISO (UTC without a zone), or seconds or milliseconds as digits; anything else is the epoch."""
    parts = [(n, table(spark, sf_dir, t)) for n, t in (("hermes", "hermes_messages"), ("codex", "codex_records"), ("grok", "grok_records"))]
    rows = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("source"), "row_id", strip(F.col("timestamp")).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("source", "row_id", F.coalesce(stored_instant(F.col("s")), F.lit(0)).alias("epoch_us"))


@query(
    f"with {views.DOCS} select doc_id, regexp_matches(\"text\", '(?m)^ASSISTANT\\s+\\[') as answered, regexp_matches(\"text\", '{distill.NO_ANSWER.replace(chr(39), chr(39) * 2)}') as claims_silence from docs"
)
def role_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that claim to have no answer, and those that have one."""
    return views.docs(spark, sf_dir).select("doc_id", F.col("text").rlike(r"(?m)^ASSISTANT\s+\[").alias("answered"), F.col("text").rlike(distill.NO_ANSWER).alias("claims_silence"))


@query(
    f"with {store_queries._VERSIONS}, a as (select row_id, source, project, content_hash, length(body) as characters, case when source in ('hermes', 'claude', 'codex', 'grok', 'projects') then 'allowed' else 'blocked' end as decision from versions) "
    "select 'req_' || substr(sha256(row_id || chr(0) || content_hash), 1, 32) as request_id, source, project, characters, decision, case when decision = 'blocked' then 'source_not_allowed' end as error_code from a"
)
def outbound_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content-free row for each version that might leave the house."""
    decision = F.when(F.col("source").isin("hermes", "claude", "codex", "grok", "projects"), "allowed").otherwise("blocked")
    a = store_queries.versions(spark, sf_dir).withColumn("decision", decision)
    return a.select(
        stable_id("req", F.col("row_id").cast("string"), F.col("content_hash")).alias("request_id"), "source", "project", F.length("body").alias("characters"),
        "decision", F.when(F.col("decision") == "blocked", "source_not_allowed").alias("error_code"),
    )


_REQUESTS = [(1, "Harbor-Console", False, None), (2, None, True, None), (3, None, False, "aurora-api"), (4, None, False, None), (5, "unknown thing", False, None), (6, None, False, "nowhere")]
_REQUEST_ROWS = ", ".join(f"({i}, {repr(p) if p else 'null'}, {str(g).lower()}, {repr(r) if r else 'null'})" for i, p, g, r in _REQUESTS)


@query(
    f"with {views.DOCS}, known as (select lower(project) as folded, arg_min(project, (n, project)) as spelling from (select project, count(*) as n from docs where project is not null group by 1) group by 1), "
    f"r(id, project, everywhere, root) as (values {_REQUEST_ROWS}) select id, case when r.project is not null then coalesce(k.spelling, r.project) when everywhere then null else w.spelling end as scope, "
    "case when r.project is not null then 'explicit' when everywhere then 'global' when w.spelling is not null then 'client_root' else 'global' end as origin "
    "from r left join known k on k.folded = lower(r.project) left join known w on w.folded = lower(r.root)"
)
def resolve_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project that each request searches in: the one named, none if asked for all, that of its root, else none."""
    from loomstead.plans.retrieval_queries import scope_projects

    known = scope_projects(spark, sf_dir).select("folded", "spelling")
    r = spark.createDataFrame(_REQUESTS, "id int, project string, everywhere boolean, root string")
    named = known.select(F.col("folded").alias("f1"), F.col("spelling").alias("s1"))
    rooted = known.select(F.col("folded").alias("f2"), F.col("spelling").alias("s2"))
    joined = r.join(named, F.lower("project") == F.col("f1"), "left").join(rooted, F.lower("root") == F.col("f2"), "left")
    explicit = F.col("project").isNotNull()
    scope = F.when(explicit, F.coalesce("s1", "project")).when(F.col("everywhere"), None).otherwise(F.col("s2"))
    origin = F.when(explicit, "explicit").when(F.col("everywhere"), "global").when(F.col("s2").isNotNull(), "client_root").otherwise("global")
    return joined.select("id", scope.alias("scope"), origin.alias("origin"))


_NAMES = ["credentials.txt", "tokenizer-notes.md", "service-account.json", "my_pwd.md", ".env.local", "id_rsa", "secrets-management.md", "README.md"]
_SECRET = ", ".join(f"'{n}'" for n in SECRET_NAMES)
_SECRET_W = ", ".join(f"'{n}'" for n in SECRET_WORDS)


@query(
    "with n as (select coalesce(title, '') as name from ingest_documents union select unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) as name), "
    "s as (select name, lower(name) as low, regexp_replace(lower(name), '(.)\\.[^.]*$', '\\1') as stem from n) "
    f"select name, low in ({_SECRET}) or stem in ({_SECRET}) or len(list_intersect(string_split_regex(stem, '[._\\s-]+'), [{_SECRET_W}])) > 0 or starts_with(low, '.env') as secret from s"
)
def secret_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which titles would be taken for credential stores as file names."""
    more = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    names = table(spark, sf_dir, "ingest_documents").select(F.coalesce("title", F.lit("")).alias("name")).unionByName(more).distinct()
    return names.select("name", looks_secret(F.col("name")).alias("secret"))


@query(
    f"select 'codex' as source, row_id, coalesce(array_to_string(list_transform(list_filter(payload.content, lambda b: lower(trim(b.type, {_WS})) in ('text', 'input_text', 'output_text') and b.text is not null), lambda b: b.text), chr(10)), '') as shown "
    "from codex_records where payload is not null union all select 'grok', row_id, case when coalesce(json_type(try_cast(params.update.content as json)), '') = 'OBJECT' and lower(coalesce(json_extract_string(try_cast(params.update.content as json), '$.type'), 'text')) in ('text', 'input_text', 'output_text') "
    "then coalesce(json_extract_string(try_cast(params.update.content as json), '$.text'), '') when coalesce(json_type(try_cast(params.update.content as json)), '') = 'OBJECT' then '' else coalesce(params.update.content, '') end from (select * from grok_records where params.update is not null) "
    "union all select 'hermes', row_id, coalesce(content, '') from hermes_messages"
)
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each record of the three tables shows: plain, of an object, or of blocks."""
    kept = F.filter("payload.content", lambda b: word(b["type"]).isin("text", "input_text", "output_text") & b["text"].isNotNull())
    shown = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    codex = table(spark, sf_dir, "codex_records").where("payload is not null").select(F.lit("codex").alias("source"), "row_id", F.coalesce(shown, F.lit("")).alias("shown"))
    content = F.col("params.update.content")
    parsed = F.when(F.ltrim(content).startswith("{"), jsonl.strict_json(content))
    said = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), jsonl.visible_text(parsed)).otherwise(F.coalesce(content, F.lit("")))
    grok = table(spark, sf_dir, "grok_records").where("params.update is not null").select(F.lit("grok").alias("source"), "row_id", said.alias("shown"))
    hermes = table(spark, sf_dir, "hermes_messages").select(F.lit("hermes").alias("source"), "row_id", F.coalesce("content", F.lit("")).alias("shown"))
    return codex.unionByName(grok).unionByName(hermes)


@query(
    f"with {dialogue_queries._UNITS} select u.session, u.unit, string_agg(upper(m.role) || ': ' || m.text, chr(10) order by m.place) as evidence from units u "
    "join n on n.session = u.session and n.ordinal between u.first_ordinal and u.last_ordinal join m on m.session = n.session and m.place = n.place group by 1, 2"
)
def evidence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages behind each unit."""
    order = Window.partitionBy("session").orderBy("place")
    n = dialogue_queries.hermes(spark, sf_dir).withColumn("unit", F.floor((F.row_number().over(order) - 1) / 12))
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    parts = n.groupBy("session", "unit").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("p"))
    return parts.select("session", "unit", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("evidence"))
