"""Queries of the whole search result, of models, generations, indexes, cohorts and the canary suite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import redact
from loomstead.functions.text import stable_id
from loomstead.operators import evaluation, hybrid, store
from loomstead.plans import dialogue_queries, retrieval_queries, store_queries, views
from loomstead.plans.registry import query
from loomstead.session import table, write_once
from loomstead.settings import Settings

SETTINGS = Settings()

_WORDS = r"""asked_words as (select query_id, list(distinct w) as words from (select query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_''-]+')) as w from queries) group by 1)"""
_PASSAGES = f"""{retrieval_queries._VARIANTS}, {_WORDS},
 vrows as (select query_id, document_id, direction, len(chunk_pks) as n, unnest(chunk_pks) as chunk_pk, generate_subscripts(chunk_pks, 1) as i from variants),
 spotted as (select r.*, content, greatest(100, 700 // n) as budget, list_min(list_filter(list_transform(words, lambda w: instr(lower(content), w)), lambda x: x > 0)) as p
   from vrows r join chunks using (chunk_pk) join asked_words using (query_id)),
 begun as (select *, greatest(0, coalesce(p - 1, 0) - budget // 3) as s from spotted),
 pieces as (select *, case when length(content) <= budget then content else case when s > 0 then '…' else '' end || trim(substr(content, s + 1, budget), ' ') || case when s + budget < length(content) then '…' else '' end end as piece from begun),
 passages as (select query_id, document_id, direction, string_agg(piece, chr(10) || chr(10) order by i) as passage from pieces group by 1, 2, 3)"""


def _words(spark: SparkSession) -> DataFrame:
    every = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)))
    return views.queries(spark).select("query_id", every.alias("words"))


def _passages(spark: SparkSession, sf_dir: str, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    chunks = views.indexed(spark, sf_dir).chunks
    made = retrieval_queries._variants(scored, chunks, SETTINGS.rerank_documents)
    return made, hybrid.passages(made, chunks, _words(spark), SETTINGS.rerank_passage)


@query(f"with {_PASSAGES} select query_id, document_id, direction, passage from passages")
def variant_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reranker reads of each variant, within its budget."""
    return _passages(spark, sf_dir, retrieval_queries._scored(spark, sf_dir))[1]


_RERANKED = f"""{_PASSAGES},
 rated as (select query_id, document_id, direction, round(len(list_filter(words, lambda w: contains(lower(passage), w)))::double / len(words), 6) as rerank_score from passages join asked_words using (query_id)),
 best as (select * from rated qualify row_number() over (partition by query_id, document_id order by rerank_score desc, case direction when 'previous' then 0 when 'next' then 1 else 2 end) = 1)"""


def _rated(passages: DataFrame, spark: SparkSession) -> DataFrame:
    """The overlap reranker as an expression; other models stand behind models.reranked()."""
    held = F.size(F.filter("words", lambda w: F.contains(F.lower("passage"), w)))
    return passages.join(F.broadcast(_words(spark)), "query_id").withColumn("rerank_score", F.round(held / F.size("words"), 6)).drop("words")


@query(f"with {_RERANKED} select query_id, document_id, direction, rerank_score from best")
def reranked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each candidate document the variant that answers best."""
    _, passages = _passages(spark, sf_dir, retrieval_queries._scored(spark, sf_dir))
    return hybrid.best_variant(_rated(passages, spark)).select("query_id", "document_id", "direction", "rerank_score")


_TAINTED = f"case when regexp_matches({{}}, '{redact.INSTRUCTION}') then 'executable_instruction,untrusted_evidence' else 'untrusted_evidence' end"


@query(
    f"""with {_RERANKED}, final as (select a.*, b.direction, b.rerank_score, row_number() over (partition by a.query_id order by b.rerank_score desc, a.score desc, a.document_id) as final_position
   from anchors a join best b using (query_id, document_id) qualify final_position <= 8),
 context as (select f.query_id, f.document_id, string_agg('chk_' || substr(sha256(f.document_id || chr(0) || c.ordinal), 1, 32) || ':' || c.ordinal || case when c.chunk_pk = f.chunk_pk then ':anchor' else '' end, ',' order by c.ordinal) as context_chunks
   from final f join variants v using (query_id, document_id, direction) join chunks c on list_contains(v.chunk_pks, c.chunk_pk) group by 1, 2)
 select f.query_id, f.final_position as position, f.document_id, 'chk_' || substr(sha256(f.document_id || chr(0) || f.ordinal), 1, 32) as chunk_id, f.ordinal as chunk_ordinal, f.rerank_score as score, f.score as retrieval_score,
   'rerank' as score_stage, l.rank as lexical_rank, v.rank as vector_rank, case when l.rank is not null and v.rank is not null then 'lexical,vector' when l.rank is not null then 'lexical' else 'vector' end as matched_via,
   'loomstead://document/' || f.document_id || '#' || f.ordinal as citation, d.source, d.project, d.title, epoch_us(d.ts) as ts_us, x.context_chunks, {_TAINTED.format("c.content")} as taints,
   'rcpt_' || substr(sha256(f.document_id || chr(0) || d.content_hash), 1, 32) as document_receipt
 from final f join docs d using (document_id) join chunks c on c.chunk_pk = f.chunk_pk join context x on x.query_id = f.query_id and x.document_id = f.document_id
 left join lexical l on l.query_id = f.query_id and l.chunk_pk = f.chunk_pk left join vector v on v.query_id = f.query_id and v.chunk_pk = f.chunk_pk"""
)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result of a search with reranking: order, ranks of the channels, citation, context, taints and receipt."""
    lex, vec = (write_once(c, "ranks") for c in retrieval_queries._channels(spark, sf_dir))
    scored = retrieval_queries._scored(spark, sf_dir, (lex, vec))
    made, passages = _passages(spark, sf_dir, scored)
    best = hybrid.best_variant(_rated(passages, spark)).select("query_id", "document_id", "direction", "rerank_score")
    anchors = hybrid.best_of_each_document(scored, SETTINGS.rerank_documents).withColumnRenamed("score", "retrieval_score").drop("position", "ts")
    top = write_once(hybrid.final_order(anchors.join(best, ["query_id", "document_id"]), SETTINGS.result_limit), "final")
    rows = views.indexed(spark, sf_dir).chunks
    near = top.join(made.select("query_id", "document_id", "direction", F.explode("chunk_pks").alias("near_pk")), ["query_id", "document_id", "direction"])
    # A result has at most two chunks, and a query at most twenty results.
    near = rows.select(F.col("chunk_pk").alias("near_pk"), F.col("ordinal").alias("near_ordinal")).join(F.broadcast(near), "near_pk")
    mark = F.concat_ws(":", stable_id("chk", F.col("document_id"), F.col("near_ordinal").cast("string")), F.col("near_ordinal").cast("string"), F.when(F.col("near_pk") == F.col("chunk_pk"), "anchor"))
    context = near.groupBy("query_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("near_ordinal", mark.alias("mark")))).alias("c"))
    context = context.select("query_id", "document_id", F.array_join(F.transform("c", lambda x: x["mark"]), ",").alias("context_chunks"))
    wide = rows.select("chunk_pk", "title", "content", "source", "project", "ts").join(F.broadcast(top), "chunk_pk")
    hashes = views.docs(spark, sf_dir).select("document_id", "content_hash").join(F.broadcast(top.select("document_id").distinct()), "document_id")
    shaped = (
        wide.join(context, ["query_id", "document_id"])
        .join(hashes, "document_id")
        .join(lex.select("query_id", "chunk_pk", F.col("rank").alias("lexical_rank")), ["query_id", "chunk_pk"], "left")
        .join(vec.select("query_id", "chunk_pk", F.col("rank").alias("vector_rank")), ["query_id", "chunk_pk"], "left")
    )
    via = F.concat_ws(",", F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("vector_rank").isNotNull(), "vector"))
    return shaped.select(
        "query_id", "position", "document_id", stable_id("chk", F.col("document_id"), F.col("ordinal").cast("string")).alias("chunk_id"), F.col("ordinal").alias("chunk_ordinal"),
        F.col("rerank_score").alias("score"), "retrieval_score", F.lit("rerank").alias("score_stage"), "lexical_rank", "vector_rank", via.alias("matched_via"),
        F.concat(F.lit("loomstead://document/"), "document_id", F.lit("#"), F.col("ordinal").cast("string")).alias("citation"), "source", "project", "title",
        F.unix_micros("ts").alias("ts_us"), "context_chunks", F.array_join(redact.taints(F.col("content")), ",").alias("taints"),
        stable_id("rcpt", F.col("document_id"), F.col("content_hash")).alias("document_receipt"),
    )


@query(
    f"with {store_queries._VERSIONS} select source, source_key, v.title, v.uri, v.project, epoch_us(i.ts) as ts_us from incoming i join stored s using (source, source_key) "
    "join (select row_id, title, uri, project from versions) v using (row_id) where s.content_hash = i.content_hash"
)
def unchanged_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written of documents whose content stays: the data of their latest delivery."""
    same = store.refreshed(store_queries.incoming(spark, sf_dir), store_queries.stored(spark, sf_dir), ["row_id", "ts"])
    data = store_queries.versions(spark, sf_dir).select("row_id", "title", "uri", "project")
    return same.join(data, "row_id").select("source", "source_key", "title", "uri", "project", F.unix_micros("ts").alias("ts_us"))


@query(
    f"{'with ' + store_queries._FLOORS}, c as (select count(*) as changed from incoming i left join stored s using (source, source_key) where s.content_hash is distinct from i.content_hash), d as (select count(*) as deleted from gone) "
    "select changed, deleted, 7 + (changed + deleted > 0)::int as generation, case when changed + deleted > 0 then 'stale' else 'ready' end as index from c, d"
)
def next_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation after this scan, counted from the seventh, and what becomes of the index."""
    stored = store_queries.stored(spark, sf_dir)
    changed = store.classify(store_queries.incoming(spark, sf_dir), stored).where("status <> 'unchanged'")
    return store.generation(7, changed, store.unseen(stored, store_queries.seen(spark, sf_dir)))


@query(
    "select embedding_model, chunks, eligible, case when eligible then 'ann' else 'exact' end as backend from (select embedding_model, count(*) as chunks, "
    "count(*) >= 1000 or (case when embedding_model like '%v1' then 800.0 else 20.0 end) >= 750 as eligible from chunk_vectors group by 1)"
)
def ann_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which models get an approximate index, by their vectors and the time an exact search took."""
    took = F.when(F.col("embedding_model").endswith("v1"), 800.0).otherwise(20.0)
    return store.index_backends(table(spark, sf_dir, "chunk_vectors"), took, SETTINGS.vector_backend, 1_000, SETTINGS.ann_latency_ms)


@query(
    f"with {store_queries._QUALIFIED}, cohort as (select document_id from qualified qualify row_number() over (partition by source order by sha256(document_id), document_id) <= 10) "
    "select d.source, count(*) as documents, sum(length(d.\"text\"))::bigint as characters from docs d join cohort using (document_id) group by 1"
)
def cohort_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pilot's documents by source: only members of the cohort are looked at."""
    members = store_queries.pilot_cohort(spark, sf_dir).select("document_id")
    return views.docs(spark, sf_dir).join(members, "document_id", "left_semi").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("characters"))


@query(
    """with u as (select file, count(*) as total, count(*) filter (payload is not null) as ready, count(*) filter (payload is null) as failed from codex_records group by 1)
 select count(*) as sessions, count(*) filter (failed = 0) as whole, coalesce(sum(total - ready), 0)::bigint as gap, coalesce(sum(failed), 0)::bigint as failed,
   greatest(greatest(0, coalesce(sum(total - ready), 0) - 5) + coalesce(sum(failed), 0), coalesce(sum(total - ready) filter (ready > 0), 0))::bigint as units_pending from u"""
)
def distillation_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that are ready, failed and pending over all sessions; five are taken to be blocked."""
    u = table(spark, sf_dir, "codex_records").groupBy("file").agg(
        F.count("*").alias("total"), F.count_if(F.col("payload").isNotNull()).alias("ready"), F.count_if(F.col("payload").isNull()).alias("failed")
    )
    gap = F.coalesce(F.sum(F.col("total") - F.col("ready")), F.lit(0))
    failed = F.coalesce(F.sum("failed"), F.lit(0))
    open_gap = F.coalesce(F.sum(F.when(F.col("ready") > 0, F.col("total") - F.col("ready"))), F.lit(0))
    return u.agg(
        F.count("*").alias("sessions"), F.count_if(F.col("failed") == 0).alias("whole"), gap.alias("gap"), failed.alias("failed"),
        F.greatest(F.greatest(F.lit(0), gap - 5) + failed, open_gap).alias("units_pending"),
    )


#: A suite of canaries: expectations that were written down, not taken from the ranking.
SUITE = {
    "version": "1",
    "cases": [
        {"id": "lease", "query_id": 1, "query": "the stale lease and the ranking floor", "phrase": "stale lease"},
        {"id": "footer", "query_id": 2, "query": "re-embedded shared footer", "phrase": "shared footer"},
        {"id": "runner", "query_id": 3, "query": "migration runner timed out on citations", "phrase": "migration runner"},
    ],
}
_CASE_ROWS = ", ".join("('{id}', {query_id}, '{phrase}')".format(**c) for c in SUITE["cases"])


@query(
    f"""with {dialogue_queries._RANKING}, cases(id, query_id, phrase) as (values {_CASE_ROWS}),
 good as (select c.id, r.position from cases c join ranking r using (query_id) join docs d using (document_id) where contains(lower(d."text"), phrase)),
 run as (select id, min(position) as fst from cases left join good using (id) group by 1)
 select count(*) as cases, count(*) filter (fst <= 3) as passed, bool_and(coalesce(fst <= 3, false)) as gate_passed, '{evaluation.suite_hash(SUITE)}' as suite from run"""
)
def canary_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite's gate: each query must find a document with its phrase among the first three."""
    suite = evaluation.checked_suite(SUITE)
    cases = spark.createDataFrame([(c["id"], c["query_id"], c["phrase"]) for c in suite["cases"]], "id string, query_id int, phrase string")
    texts = views.docs(spark, sf_dir).select("document_id", F.lower("text").alias("text"))
    ranked = dialogue_queries._ranking(spark, sf_dir).join(F.broadcast(cases), "query_id")
    good = texts.join(F.broadcast(ranked), "document_id").where(F.contains("text", F.col("phrase")))
    run = cases.join(good.groupBy("id").agg(F.min("position").alias("first")), "id", "left")
    fine = F.coalesce(F.col("first") <= 3, F.lit(False))
    return run.agg(F.count("*").alias("cases"), F.count_if(fine).alias("passed"), F.bool_and(fine).alias("gate_passed")).withColumn("suite", F.lit(evaluation.suite_hash(suite)))


@query(
    f"""with {views.CHUNKS}, w as (select chunk_pk, sha256(c.title || chr(10) || chr(10) || content) as input_hash, case when doc_id % 4 = 0 then 'b' else 'a' end as model, 64 as dims from chunks c),
 cache as (select distinct input_hash, model, dims from w where (chunk_pk // 1073741824) % 3 = 0)
 select input_hash, model, dims, min(chunk_pk) as "first", count(*) as uses, case when c.input_hash is null then 'embed' else 'cache' end as origin from w left join cache c using (input_hash, model, dims) group by all"""
)
def embedding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are embedded and which vectors are taken over, where a third of the documents has been embedded before."""
    c = views.chunks(spark, sf_dir)
    wanted = c.select(
        "chunk_pk", F.sha2(F.concat("title", F.lit("\n\n"), "content"), 256).alias("input_hash"), F.when(F.col("doc_id") % 4 == 0, "b").otherwise("a").alias("model"), F.lit(64).alias("dims"), "doc_id"
    )
    return store.embedding_plan(wanted, wanted.where("doc_id % 3 = 0"))


@query(
    """with a as (select 'document' as artifact_type, document_id as artifact_id, content_hash from stored_documents union all
   select distinct 'chunk', document_id || ':' || ordinal, '' from chunk_vectors where document_id is not null and ordinal is not null),
 r as (select 'document' as artifact_type, document_id as artifact_id from stored_documents where run_id % 2 = 0)
 select artifact_type, artifact_id, 'rcpt_' || substr(sha256(artifact_type || chr(0) || artifact_id || chr(0) || content_hash || chr(0) || 'backfill' || chr(0) || '1'), 1, 32) as receipt_id
 from a where (artifact_type, artifact_id) not in (select (artifact_type, artifact_id) from r) and content_hash is not null"""
)
def backfill_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts that documents and chunks lack, where those of even runs are superseded or missing."""
    d = table(spark, sf_dir, "stored_documents")
    documents = d.where("content_hash is not null").select(F.lit("document").alias("artifact_type"), F.col("document_id").alias("artifact_id"), "content_hash")
    places = table(spark, sf_dir, "chunk_vectors").where("document_id is not null and ordinal is not null").select("document_id", "ordinal").distinct()
    chunks = places.select(F.lit("chunk").alias("artifact_type"), F.concat_ws(":", "document_id", F.col("ordinal").cast("string")).alias("artifact_id"), F.lit("").alias("content_hash"))
    ended = F.when(F.coalesce(F.col("run_id") % 2 != 0, F.lit(True)), F.current_timestamp())
    held = d.select(F.lit("document").alias("artifact_type"), F.col("document_id").alias("artifact_id"), ended.alias("superseded_at"))
    every = documents.unionByName(chunks).withColumns({"producer": F.lit("backfill"), "producer_version": F.lit("1")})
    return store.missing_receipts(every, held).select("artifact_type", "artifact_id", "receipt_id")


@query(
    f"""with {views.DOCS} select document_id, 'dst_' || substr(sha256(document_id || chr(0) || content_hash || chr(0) || 'extractive' || chr(0) || 'v1'), 1, 32) as distillation_id,
 'rcpt_' || substr(sha256('document' || chr(0) || document_id || chr(0) || content_hash || chr(0) || 'ingest:' || source || chr(0) || '1'), 1, 32) as receipt_id from docs"""
)
def artifact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document's summary and receipt, from all that they depend on."""
    d = F.col("document_id")
    return views.docs(spark, sf_dir).select(
        "document_id", stable_id("dst", d, F.col("content_hash"), F.lit("extractive"), F.lit("v1")).alias("distillation_id"),
        stable_id("rcpt", F.lit("document"), d, F.col("content_hash"), F.concat(F.lit("ingest:"), "source"), F.lit("1")).alias("receipt_id"),
    )


@query(
    """with v as (select embedding_model, embedding, embedding_dimensions, ordinal, document_id, chunk_pk, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as size,
   len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) as bad from chunk_vectors),
 p as (select document_id, embedding_model, max(ordinal) - min(ordinal) + 1 - count(distinct ordinal) as gap from v where document_id is not null group by 1, 2),
 g as (select embedding_model, count(*) filter (gap > 0) as documents_with_gaps from p group by 1)
 select embedding_model, count(*) filter (embedding is not null and len(embedding) = 0) as empty, count(*) filter (bad > 0) as not_finite, count(*) filter (bad = 0 and size = 0) as zero,
   count(*) filter (bad = 0 and size > 0 and abs(sqrt(size) - 1) > 0.01) as not_unit, count(*) filter (ordinal is null) as no_ordinal, count(*) filter (document_id is null) as no_document,
   count(*) - count(distinct chunk_pk) as repeated_keys, any_value(documents_with_gaps) as documents_with_gaps from v left join g using (embedding_model) group by 1"""
)
def vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rules that vectors may break: empty, not finite, zero or not of unit length, without a place, keys twice, gaps in a document."""
    v = table(spark, sf_dir, "chunk_vectors")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    v = v.withColumn("_bad", bad).withColumn("_size", F.when(~bad, size))
    places = v.where("document_id is not null").groupBy("document_id", "embedding_model").agg((F.max("ordinal") - F.min("ordinal") + 1 - F.countDistinct("ordinal")).alias("gap"))
    gaps = places.groupBy("embedding_model").agg(F.count_if(F.col("gap") > 0).alias("documents_with_gaps"))
    counted = v.groupBy("embedding_model").agg(
        F.count_if(F.size("embedding") == 0).alias("empty"), F.count_if("_bad").alias("not_finite"), F.count_if((F.col("_size") == 0) & (F.size("embedding") > 0)).alias("zero"),
        F.count_if((F.col("_size") > 0) & (F.abs(F.sqrt("_size") - 1) > 0.01)).alias("not_unit"), F.count_if(F.col("ordinal").isNull()).alias("no_ordinal"),
        F.count_if(F.col("document_id").isNull()).alias("no_document"), (F.count("*") - F.countDistinct("chunk_pk")).alias("repeated_keys"),
    )
    return counted.join(gaps, "embedding_model", "left")


_CURRENT = f"""{store_queries._VERSIONS}, fit as (select document_id from chunk_vectors group by 1 having bool_and(coalesce(embedding_model = 'local/mini-embed-v2' and embedding_dimensions = 64, false))),
 known as (select s.*, f.document_id is not null as fits from stored s left join fit f using (document_id)),
 states as (select i.*, k.document_id, case when k.content_hash is null then 'created' when k.content_hash = i.content_hash and k.fits then 'unchanged' else 'updated' end as status from incoming i left join known k using (source, source_key))"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = store_queries.stored(spark, sf_dir)
    current = store.current_documents(held, table(spark, sf_dir, "chunk_vectors"), "local/mini-embed-v2", 64)
    states = store.classify(store_queries.incoming(spark, sf_dir), held, current)
    return states.join(held.select(*store.KEY, "document_id"), store.KEY, "left")


@query(f"with {_CURRENT} select source, source_key, status from states")
def classify_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each incoming document does to the store, where chunks of another model are made anew."""
    return _states(spark, sf_dir).select("source", "source_key", "status")


@query(
    f"""with {_CURRENT}, changed as (select document_id, row_id from states where status = 'updated'),
 made as (select document_id, unnest(range(0, len(string_split_regex(body, '\n[ \t]*\n')))) as ordinal from changed join (select row_id, body from versions) using (row_id)),
 kept as (select distinct document_id, ordinal::bigint as ordinal from chunk_vectors where document_id is null or document_id not in (select document_id from changed))
 select document_id, ordinal, is_new, case when document_id is not null then 'chk_' || substr(sha256(document_id || chr(0) || coalesce(ordinal::varchar, '')), 1, 32) end as chunk_id from (
   select document_id, ordinal, false as is_new from kept union all select document_id, ordinal, true from made) where document_id is not null and ordinal is not null"""
)
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks after the updated documents' old ones have given way to the paragraphs of their new texts."""
    updated = _states(spark, sf_dir).where("status = 'updated'")
    texts = store_queries.versions(spark, sf_dir).select("row_id", "body").join(updated.select("row_id", "document_id"), "row_id")
    new = texts.select("document_id", F.posexplode(F.split("body", r"\n[ \t]*\n")).alias("ordinal", "_part")).select("document_id", F.col("ordinal").cast("long").alias("ordinal"))
    old = table(spark, sf_dir, "chunk_vectors").select("document_id", F.col("ordinal").cast("long").alias("ordinal")).where("document_id is not null and ordinal is not null")
    return store.replaced_chunks(old, new, updated.select("document_id").distinct())


_SCOPES = [
    (1, "Harbor-Console", False, [], None), (2, None, True, ["aurora-api"], None), (3, None, False, ["aurora-api"], None), (4, None, False, ["Aurora-API", "nowhere"], None),
    (5, None, False, ["aurora-api", "harbor-console"], "cinder-cli"), (6, None, False, [], "CINDER-CLI"), (7, None, False, ["nowhere"], None), (8, "unknown", True, [], None), (9, "unknown thing", False, [], "cinder-cli"),
]
_SCOPE_ROWS = ", ".join(f"({i}, {repr(p) if p else 'null'}, {str(g).lower()}, {r}::varchar[], {repr(c) if c else 'null'})" for i, p, g, r, c in _SCOPES)


@query(
    f"""with {views.DOCS}, known as (select lower(project) as folded, arg_min(project, (n, project)) as spelling from (select project, count(*) as n from docs where project is not null group by 1) group by 1),
 r(id, project, everywhere, roots, cwd) as (values {_SCOPE_ROWS}),
 rooted as (select id, count(distinct spelling) as n, min(spelling) as one from (select id, unnest(roots) as root from r) join known on folded = lower(root) group by 1)
 select r.id, case when r.project is not null and everywhere then null when r.project is not null then coalesce(k.spelling, r.project) when everywhere then null when n = 1 then one when n > 1 then null else c.spelling end as scope,
   case when r.project is not null and everywhere then 'error' when r.project is not null then 'explicit' when everywhere then 'global' when n = 1 then 'client_root' when n > 1 then 'ambiguous_roots' when c.spelling is not null then 'cwd' else 'global' end as origin
 from r left join known k on k.folded = lower(r.project) left join rooted using (id) left join known c on c.folded = lower(r.cwd)"""
)
def search_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each request searches: its project, everywhere, the one project of its roots, that of its folder; a project and everywhere is an error."""
    known = retrieval_queries.scope_projects(spark, sf_dir).select("folded", "spelling")
    r = spark.createDataFrame(_SCOPES, "id int, project string, everywhere boolean, roots array<string>, cwd string")
    rooted = r.select("id", F.explode("roots").alias("root")).join(known, F.lower("root") == F.col("folded")).groupBy("id").agg(F.countDistinct("spelling").alias("n"), F.min("spelling").alias("one"))
    named = known.select(F.col("folded").alias("f1"), F.col("spelling").alias("s1"))
    here = known.select(F.col("folded").alias("f2"), F.col("spelling").alias("s2"))
    all_ = r.join(rooted, "id", "left").join(named, F.lower("project") == F.col("f1"), "left").join(here, F.lower("cwd") == F.col("f2"), "left")
    explicit, both = F.col("project").isNotNull(), F.col("project").isNotNull() & F.col("everywhere")
    scope = F.when(both, None).when(explicit, F.coalesce("s1", "project")).when(F.col("everywhere"), None).when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, None).otherwise(F.col("s2"))
    origin = (
        F.when(both, "error").when(explicit, "explicit").when(F.col("everywhere"), "global").when(F.col("n") == 1, "client_root")
        .when(F.col("n") > 1, "ambiguous_roots").when(F.col("s2").isNotNull(), "cwd").otherwise("global")
    )
    return all_.select("id", scope.alias("scope"), origin.alias("origin"))


@query(
    f"with {store_queries._VERSIONS}, m as (select content_hash, min(row_id) as row_id, count(*) as deliveries from versions where kind = 'memory' group by 1) "
    "select 'mem_' || substr(content_hash, 1, 32) as source_key, row_id, deliveries, content_hash in (select content_hash from stored where content_hash is not null) as held from m"
)
def saved_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories by their content, and whether the store holds that content already, so that it isn't saved again."""
    v = store_queries.versions(spark, sf_dir).where("kind = 'memory'")
    m = v.groupBy("content_hash").agg(F.min("row_id").alias("row_id"), F.count("*").alias("deliveries"))
    held = store_queries.stored(spark, sf_dir).where("content_hash is not null").select("content_hash", F.lit(True).alias("held")).distinct()
    return m.join(held, "content_hash", "left").select(F.concat(F.lit("mem_"), F.substring("content_hash", 1, 32)).alias("source_key"), "row_id", "deliveries", F.coalesce("held", F.lit(False)).alias("held"))


@query(
    """with sized as (select chunk_pk, embedding_model, source, embedding, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as size from chunk_vectors
   where embedding is not null and len(embedding) = embedding_dimensions and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 v as (select chunk_pk, embedding_model, source, list_transform(embedding, lambda x: x::double / sqrt(size)) as unit from sized where size > 0)
 select q.chunk_pk as query_id, v.chunk_pk, row_number() over (partition by q.chunk_pk order by round(list_sum(list_transform(list_zip(q.unit, v.unit), lambda x: x[1] * x[2])), 9) desc, v.chunk_pk desc) as rank
 from v, v q where q.chunk_pk % 50 = 0 and q.embedding_model = v.embedding_model and v.source in ('codex', 'claude', 'projects') qualify rank <= 10"""
)
def chunk_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten chunks of three sources nearest to every chunk whose key is divisible by 50, by cosine, within its model.

    Vectors that aren't usable (null, of another length than stated, not finite, zero) neither ask nor are found.
    """
    v = table(spark, sf_dir, "chunk_vectors").where(F.col("embedding").isNotNull() & (F.size("embedding") == F.col("embedding_dimensions")) & (F.size("embedding") > 0))
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    size = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    v = v.withColumn("_size", size).where("_size > 0")
    v = v.select("chunk_pk", "embedding_model", "source", F.transform("embedding", lambda x: x.cast("double") / F.sqrt("_size")).alias("embedding"))
    asked = v.where("chunk_pk % 50 = 0").select(F.col("chunk_pk").alias("query_id"), F.col("embedding").alias("vector"), F.col("embedding_model").alias("own"))
    some = v.where(hybrid.filters(["codex", "claude", "projects"]))
    top = hybrid.exact_topk(some, asked, 10, "embedding_model")
    return top.join(asked.select("query_id", F.col("own").alias("embedding_model")), ["query_id", "embedding_model"]).select("query_id", "chunk_pk", "rank")


_ATTEMPTS = """a as (select distinct source, run_id % 7 as unit, run_id, started_at, successful, error, source = 'grok' and run_id % 7 = 3 as blocked from scan_runs where started_at is not null and run_id is not null),
 got as (select source, unit, count(*) as attempts, max(started_at) as last_at, max(started_at) filter (successful) as last_success,
   arg_max(error, (started_at, run_id)) filter (error is not null) as last_error, bool_or(blocked) as blocked,
   arg_max(case when successful then 'ready' when not successful then 'failed' else 'pending' end, (started_at, run_id)) as last from a group by 1, 2),
 units as (select *, case when blocked then 'policy_blocked' else last end as state from got)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as attempts at seven units of each source, one of which may not be sent anywhere."""
    r = table(spark, sf_dir, "scan_runs").where("started_at is not null and run_id is not null")
    r = r.select("source", (F.col("run_id") % 7).alias("unit"), "run_id", "started_at", F.col("successful").alias("outcome"), "error").distinct()
    r = r.withColumn("blocked", F.coalesce((F.col("source") == "grok") & (F.col("unit") == 3), F.lit(False)))
    return store.attempt_states(r, ["source", "unit"], ["started_at", "run_id"])


@query(f"with {_ATTEMPTS} select source, unit, state, attempts, epoch_us(last_at) as last_us, epoch_us(last_success) as success_us, last_error from units")
def unit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each unit after all attempts at it."""
    return _attempts(spark, sf_dir).select(
        "source", "unit", "state", "attempts", F.unix_micros("last_at").alias("last_us"), F.unix_micros("last_success").alias("success_us"), "last_error"
    )


@query(
    f"with {_ATTEMPTS}, n as (select source, count(*) as units, count(*) filter (state = 'ready') as ready, count(*) filter (state = 'failed') as failed, count(*) filter (state = 'pending') as pending, "
    "count(*) filter (state = 'policy_blocked') as policy_blocked from units group by 1) select *, case when ready = units then 'ready' when ready > 0 then 'partial' else 'failed' end as status from n"
)
def unit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's units by state, and its status."""
    return store.rollup(_attempts(spark, sf_dir), ["source"])


_COHORT = """cohort as (select doc_id, document_id, title, source from docs where source in ('hermes', 'claude', 'codex', 'grok') qualify row_number() over (partition by source order by sha256(document_id), document_id) <= 5),
 queries as (select doc_id as query_id, title as query from cohort)"""
_SELF = views.BM25.replace(f"queries(query_id, query) as (values {views.QUERY_SQL})", _COHORT)


@query(
    f"""with {_SELF}, per as (select query_id, document_id, max(round(score, 9)) as score from scores join chunks using (chunk_pk) group by all),
 own as (select c.doc_id as query_id, c.document_id, c.source, score from cohort c left join per p on p.query_id = c.doc_id and p.document_id = c.document_id),
 better as (select o.query_id, count(*) as every, count(*) filter (d.source = o.source) as scoped from own o join per p on p.query_id = o.query_id and (p.score > o.score or p.score = o.score and p.document_id < o.document_id)
   join docs d on d.document_id = p.document_id group by 1)
 select document_id, case when score is not null then 1 + coalesce(every, 0) end as rank_everywhere, case when score is not null then 1 + coalesce(scoped, 0) end as rank_in_source from own left join better using (query_id)"""
)
def self_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the title of each of five dialogues of a source finds its own document, among all and within the source."""
    d = views.docs(spark, sf_dir).where("source in ('hermes', 'claude', 'codex', 'grok')").select("doc_id", "document_id", "title", "source")
    order = Window.partitionBy("source").orderBy(F.sha2("document_id", 256), "document_id")
    # At most five of four sources.
    cohort = write_once(d.withColumn("_n", F.row_number().over(order)).where("_n <= 5").drop("_n"), "cohort")
    built = views.indexed(spark, sf_dir)
    scores = built.bm25(cohort.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))).withColumn("score", F.round("score", 9))
    of_document = built.chunks.select("chunk_pk", F.col("document_id").alias("found"), F.col("source").alias("found_source"))
    per = scores.join(of_document, "chunk_pk").groupBy("query_id", "found", "found_source").agg(F.max("score").alias("score"))
    asked = F.broadcast(cohort.select(F.col("doc_id").alias("query_id"), "document_id", "source"))
    known = write_once(per.join(asked, "query_id"), "found")
    own = known.where("found = document_id").select("query_id", F.col("score").alias("own"))
    ahead = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("found") < F.col("document_id")))
    # Counted, not sorted: a query may match any number of documents.
    better = known.join(F.broadcast(own), "query_id").groupBy("query_id").agg(
        F.count_if(ahead).alias("every"), F.count_if(ahead & (F.col("found_source") == F.col("source"))).alias("scoped")
    )
    return cohort.join(better, F.col("doc_id") == F.col("query_id"), "left").select("document_id", (F.col("every") + 1).alias("rank_everywhere"), (F.col("scoped") + 1).alias("rank_in_source"))
