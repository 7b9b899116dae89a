"""Queries of full-text, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.operators import hybrid, lexical
from loomstead.plans import views
from loomstead.plans.registry import query
from loomstead.session import table, write_once


def _lexical(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    # Scores are compared to 9 decimals, so that the order of a sum can't change a rank.
    scores = views.indexed(spark, sf_dir).bm25(views.queries(spark)).withColumn("score", F.round("score", 9))
    return lexical.ranked(scores, limit)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, as a query."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that stand for the four text queries."""
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id").isin(1, 2, 3, 4)).select(F.col("vec_id").cast("int").alias("query_id"), F.col("embedding").alias("vector"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") * views.PLACES).alias("chunk_pk"), "embedding", "label", F.col("vec_id").alias("doc_id"))


@query(
    f"with {views.CHUNKS}, t as (select distinct doc_id, unnest({views.tokens_sql('content')}) as term from chunks) "
    "select term, count(*) as n_docs from t group by term"
)
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each token stands."""
    c = views.chunks(spark, sf_dir).select("doc_id", F.explode(lexical.tokens(F.col("content"))).alias("term"))
    return c.distinct().groupBy("term").agg(F.count("*").alias("n_docs"))


@query(f"with {views.BM25} select query_id, chunk_pk, rank, round(score, 6) as score from lexical where rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each query by BM25, phrases included."""
    return _lexical(spark, sf_dir, 20).select("query_id", "chunk_pk", "rank", F.round("score", 6).alias("score"))


@query(
    f"with {views.BM25} select query_id, chunk_pk, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pk) as rank "
    "from scores join (select chunk_pk, doc_id from chunks) using (chunk_pk) join docs using (doc_id) where source = 'codex' "
    "qualify rank <= 10"
)
def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of one source; term weights stay those of the whole collection."""
    built = views.indexed(spark, sf_dir)
    scores = built.bm25(views.queries(spark)).withColumn("score", F.round("score", 9))
    own = built.chunks.where("source = 'codex'").select("chunk_pk")
    return lexical.ranked(scores.join(own, "chunk_pk"), 10).select("query_id", "chunk_pk", "rank")


@query(f"with {views.BM25} select query_id, phrase_id, count(*) as n_chunks, sum(tf) as tf from hits where (query_id, phrase_id) in (select (query_id, phrase_id) from qt where places > 1) group by all")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the phrases of the queries stand in how many chunks."""
    hits = views.indexed(spark, sf_dir).hits(views.queries(spark), F.col("places") > 1)
    return hits.groupBy("query_id", "phrase_id").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("tf"))


@query(
    f"with {views.BM25}, df as (select term, count(distinct chunk_pk) as n from posting group by 1) "
    "select query_id, word, coalesce(n, 0) as n, row_number() over (partition by query_id order by coalesce(n, 0), phrase_id) as kept_rank "
    "from words left join df on word = term qualify kept_rank <= 2"
)
def fts_term_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest words of each query."""
    words = views.queries(spark).select(F.explode(lexical.query_words(F.col("query"))).alias("term"))
    frequency = views.indexed(spark, sf_dir).postings(words).select("term", "chunk_pk").distinct().groupBy("term").agg(F.count("*").alias("n"))
    return lexical.capped_terms(views.queries(spark), frequency, 2)


_VECTOR = """v as (select vec_id * 1073741824 as chunk_pk, embedding, label, vec_id as doc_id from embeddings),
 q as (select vec_id as query_id, embedding as vector from embeddings where vec_id in (1, 2, 3, 4)),
 asked as (select vec_id as query_id, embedding as vector from embeddings where vec_id % 50 = 0),
 av as (select query_id, chunk_pk, label, round(list_sum(list_transform(list_zip(embedding::double[], vector::double[]), lambda x: x[1] * x[2])), 9) as score from v, asked),
 vs as (select query_id, chunk_pk, label, doc_id, list_sum(list_transform(list_zip(embedding::double[], vector::double[]), lambda x: x[1] * x[2])) as score from v, q)"""


def _vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.vector_scores(_vectors(spark, sf_dir), _query_vectors(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(
    f"with {_VECTOR} select query_id, chunk_pk, row_number() over (partition by query_id order by score desc, chunk_pk desc) as rank, "
    "round(score, 6) as score from av qualify rank <= 50"
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vectors of every vector whose id is divisible by 50; ties go to the larger chunk_pk."""
    top = hybrid.exact_topk(_vectors(spark, sf_dir), _asked(spark, sf_dir), 50)
    return top.select("query_id", "chunk_pk", "rank", F.round("score", 6).alias("score"))


@query(
    f"with {_VECTOR} select query_id, chunk_pk, row_number() over (partition by query_id order by score desc, chunk_pk desc) as rank "
    "from av where label in (1, 2, 3) qualify rank <= 10"
)
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vectors among those with some labels; the filter comes before the ranking."""
    some = _vectors(spark, sf_dir).where("label in (1, 2, 3)")
    return hybrid.exact_topk(some, _asked(spark, sf_dir), 10).select("query_id", "chunk_pk", "rank")


@query(
    f"with {_VECTOR} select query_id, label, chunk_pk, row_number() over (partition by query_id, label order by score desc, chunk_pk desc) as rank "
    "from av qualify rank <= 3"
)
def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vectors of each label."""
    top = hybrid.exact_topk(_vectors(spark, sf_dir), _asked(spark, sf_dir), 3, "label")
    return top.select("query_id", "label", "chunk_pk", "rank")


_FUSED = f"""{views.BM25}, {_VECTOR},
 vector as (select * from (select query_id, chunk_pk, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pk desc) as rank from vs) where rank <= 50),
 fused as (select query_id::int as query_id, chunk_pk, sum(1.0::double / (60 + rank)) as rrf from (
    select query_id, chunk_pk, rank from lexical union all select query_id, chunk_pk, rank from vector) group by all)"""


def _channels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _lexical(spark, sf_dir), lexical.ranked(_vector_scores(spark, sf_dir), 50, F.desc("chunk_pk"))


@query(f"with {_FUSED} select query_id, chunk_pk, round(rrf, 9) as rrf from fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both channels fused by reciprocal ranks."""
    return hybrid.fuse(*_channels(spark, sf_dir)).withColumn("rrf", F.round("rrf", 9))


@query(
    f"with {views.DOCS} select doc_id, round(0.7 + 0.3 * exp(-greatest(0.0, (epoch_us(timestamptz '{views.NOW}+00') - epoch_us(ts)) / 86400000000.0) / 180.0), 9) as recency "
    "from docs where ts is not null"
)
def recency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each document's age lowers its score."""
    now = F.to_timestamp(F.lit(views.NOW))
    return views.docs(spark, sf_dir).where("ts is not null").select("doc_id", F.round(hybrid.recency(F.col("ts"), now), 9).alias("recency"))


_BEST = f"""{_FUSED},
 scored as (select query_id, chunk_pk, document_id, ordinal, round(rrf * (0.7 + 0.3 * exp(-greatest(0.0, (epoch_us(timestamptz '{views.NOW}+00') - epoch_us(coalesce(ts, timestamptz '1970-01-01 00:00:00+00'))) / 86400000000.0) / 180.0)), 9) as score
    from fused join chunks using (chunk_pk) join (select document_id, ts from docs) using (document_id)),
 anchors as (select *, row_number() over (partition by query_id order by score desc, chunk_pk) as position from (
    select * from (select *, row_number() over (partition by query_id, document_id order by score desc, chunk_pk) as n from scored) where n = 1) qualify position <= 20)"""


def _scored(spark: SparkSession, sf_dir: str, channels: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The fused chunks with their scores: at most two channels' ranks of each query, so small enough to be kept."""
    fused = hybrid.fuse(*(channels or _channels(spark, sf_dir)))
    now, epoch = F.to_timestamp(F.lit(views.NOW)), F.timestamp_seconds(F.lit(0))
    # Ranks first, wide rows afterwards: at most 100 chunks of each query are looked up.
    rows = views.indexed(spark, sf_dir).chunks.select("chunk_pk", "document_id", "ordinal", "ts")
    timed = rows.join(F.broadcast(fused), "chunk_pk")
    return write_once(timed.withColumn("score", F.round(F.col("rrf") * hybrid.recency(F.coalesce("ts", epoch), now), 9)), "scored")


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.best_of_each_document(_scored(spark, sf_dir))


def _variants(scored: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """Variants of the anchors: only chunks of their few documents are looked at."""
    anchors = hybrid.best_of_each_document(scored, most)
    near = chunks.select("document_id", "ordinal", "chunk_pk")
    return hybrid.variants(anchors, near.join(F.broadcast(anchors.select("document_id").distinct()), "document_id", "left_semi"))


@query(f"with {_BEST} select query_id, document_id, chunk_pk, position, score from anchors")
def best_chunk_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunk of each document, of each query the best documents."""
    return _anchors(spark, sf_dir).select("query_id", "document_id", "chunk_pk", "position", "score")


_VARIANTS = f"""{_BEST},
 sides as (select a.query_id, a.document_id, case when c.ordinal < a.ordinal then 'previous' else 'next' end as direction,
    case when c.ordinal < a.ordinal then [c.chunk_pk, a.chunk_pk] else [a.chunk_pk, c.chunk_pk] end as chunk_pks, c.chunk_pk as near_pk
    from anchors a join chunks c on a.document_id = c.document_id and abs(c.ordinal - a.ordinal) = 1),
 variants as (select * from sides union all select query_id, document_id, 'anchor', [chunk_pk], null from anchors
    where (query_id, document_id) not in (select (query_id, document_id) from sides))"""


@query(f"with {_VARIANTS} select query_id, document_id, direction, chunk_pks::varchar as chunk_pks from variants")
def neighbour_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor with the chunk before, the chunk after, or alone."""
    made = hybrid.variants(_anchors(spark, sf_dir), views.indexed(spark, sf_dir).chunks)
    text = F.concat(F.lit("["), F.array_join(F.col("chunk_pks").cast("array<string>"), ", "), F.lit("]"))
    return made.select("query_id", "document_id", "direction", text.alias("chunk_pks"))


_CHOSEN = f"""{_VARIANTS},
 chosen as (select v.query_id, v.document_id, v.direction from variants v
    left join scored s on s.query_id = v.query_id and s.chunk_pk = v.near_pk
    qualify row_number() over (partition by v.query_id, v.document_id order by coalesce(s.score, -1) desc, (v.direction = 'next')::int desc) = 1)"""


@query(f"with {_CHOSEN} select * from chosen")
def fallback_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that is shown when nothing reranks."""
    scored = _scored(spark, sf_dir)
    return hybrid.fallback_variant(_variants(scored, views.indexed(spark, sf_dir).chunks), scored).select("query_id", "document_id", "direction")


@query(
    f"with {_CHOSEN} select a.query_id, a.position, a.document_id, a.chunk_pk, a.ordinal, a.score, l.rank as lexical_rank, v.rank as vector_rank, "
    "case when l.rank is not null and v.rank is not null then 'lexical,vector' when l.rank is not null then 'lexical' else 'vector' end as matched_via, "
    "c.direction, d.source, d.project, 'loomstead://document/' || a.document_id || '#' || a.ordinal as citation "
    "from anchors a join chosen c using (query_id, document_id) join docs d using (document_id) "
    "left join lexical l on l.query_id = a.query_id and l.chunk_pk = a.chunk_pk left join vector v on v.query_id = a.query_id and v.chunk_pk = a.chunk_pk "
    "where a.position <= 10"
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: both channels, fusion, recency, best chunk of a document, neighbour, citation."""
    # Ranks of 50 chunks in each channel are kept; all that follows reads them instead of ranking again.
    lex, vec = (write_once(c, "ranks") for c in _channels(spark, sf_dir))
    scored = _scored(spark, sf_dir, (lex, vec))
    kept = views.indexed(spark, sf_dir).chunks
    anchors = hybrid.best_of_each_document(scored, 10)
    chosen = hybrid.fallback_variant(_variants(scored, kept, 10), scored)
    shaped = (
        anchors.join(chosen.select("query_id", "document_id", "direction"), ["query_id", "document_id"])
        .join(lex.select("query_id", "chunk_pk", F.col("rank").alias("lexical_rank")), ["query_id", "chunk_pk"], "left")
        .join(vec.select("query_id", "chunk_pk", F.col("rank").alias("vector_rank")), ["query_id", "chunk_pk"], "left")
        .join(kept.select("chunk_pk", "source", "project"), "chunk_pk")
    )
    via = F.concat_ws(",", F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("vector_rank").isNotNull(), "vector"))
    citation = F.concat(F.lit("loomstead://document/"), "document_id", F.lit("#"), F.col("ordinal").cast("string"))
    return shaped.select(
        "query_id", "position", "document_id", "chunk_pk", "ordinal", "score", "lexical_rank", "vector_rank", via.alias("matched_via"),
        "direction", "source", "project", citation.alias("citation"),
    )


def page(chunks: DataFrame, document_id: str, offset: int, limit: int) -> DataFrame:
    """A page of one document's chunks with `next_offset`, null on the last; the limit is 1 to 50, the offset not below 0."""
    offset, limit = max(0, offset), max(1, min(50, limit))
    own = chunks.where(F.col("document_id") == document_id)
    rows = own.orderBy("ordinal").offset(offset).limit(limit + 1).withColumn("_at", F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal")))
    more = F.max("_at").over(Window.partitionBy("document_id")) > limit
    return rows.withColumn("next_offset", F.when(more, offset + limit)).where(F.col("_at") <= limit).drop("_at")


@query(
    f"with {views.CHUNKS}, wide as (select document_id, count(*) as n from chunks group by 1 order by n desc, document_id limit 1), own as (select c.*, n, row_number() over (order by ordinal) as nth from chunks c join wide using (document_id)) "
    "select document_id, ordinal, content, case when n > 4 then 4 end as next_offset from own where nth between 2 and 4"
)
def page_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to fourth chunk of the document with most, and where to go on."""
    kept = views.indexed(spark, sf_dir).chunks
    first = kept.groupBy("document_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_id").limit(1).collect()
    return page(kept, first[0].document_id if first else "", 1, 3).select("document_id", "ordinal", "content", "next_offset")


_SINCE = "2026-06-01 00:00:00"


@query(
    f"with {views.BM25}, kept as (select chunk_pk from chunks join (select document_id, source, project, ts from docs) using (document_id) where source in ('codex', 'claude') and project is not null and ts >= timestamptz '{_SINCE}+00') "
    "select query_id, chunk_pk, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pk) as rank from scores join kept using (chunk_pk) qualify rank <= 10"
)
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of two sources, of a project, since a time; filters come before the ranking, weights are those of all."""
    built = views.indexed(spark, sf_dir)
    some = built.chunks.where(hybrid.filters(["CODEX", " claude"], None, F.to_timestamp(F.lit(_SINCE))) & F.col("project").isNotNull()).select("chunk_pk")
    scores = built.bm25(views.queries(spark)).withColumn("score", F.round("score", 9))
    return lexical.ranked(scores.join(some, "chunk_pk"), 10).select("query_id", "chunk_pk", "rank")


@query(f"with {views.DOCS} select lower(project) as folded, arg_min(project, (n, project)) as spelling, sum(n)::bigint as documents from (select project, count(*) as n from docs where project is not null group by 1) group by 1")
def scope_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known projects regardless of case, with the spelling that a search resolves to (the rarest)."""
    known = views.docs(spark, sf_dir).where("project is not null").groupBy("project").agg(F.count("*").alias("n"))
    return known.groupBy(F.lower("project").alias("folded")).agg(
        F.min_by("project", F.struct("n", "project")).alias("spelling"), F.sum("n").alias("documents")
    )


@query(
    f"with {views.DOCS}, m as (select doc_id, \"text\", list_min(list_filter([instr(lower(\"text\"), 'lease'), instr(lower(\"text\"), 'footer')], lambda x: x > 0)) as p from docs), "
    "w as (select *, greatest(0, coalesce(p - 1, 0) - 100) as s from m) select doc_id, case when length(\"text\") <= 300 then \"text\" else "
    "case when s > 0 then '…' else '' end || trim(substr(\"text\", s + 1, 300), ' ') || case when s + 300 < length(\"text\") then '…' else '' end end as passage from w"
)
def rerank_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage of each document around the first of two words."""
    words = F.array(F.lit("lease"), F.lit("footer"))
    return views.docs(spark, sf_dir).select("doc_id", hybrid.passage(F.col("text"), words, 300).alias("passage"))
