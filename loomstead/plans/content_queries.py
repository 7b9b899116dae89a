"""Queries of chunking, units, snippets, summaries and the approximate index; most have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import redact
from loomstead.functions.text import WHITE_SPACE, word
from loomstead.operators import chunking, distill, embedding, hybrid, lexical, snippets
from loomstead.operators.headings import has_headings
from loomstead.plans import retrieval_queries, store_queries, views
from loomstead.plans.registry import query
from loomstead.session import spread, table, write_once


def packed_chunks(spark: SparkSession, sf_dir: str, sources: tuple[str, ...] | None = None) -> DataFrame:
    """Chunks of the delivered documents, or of those of some sources."""
    d = spread(table(spark, sf_dir, "ingest_documents").select("row_id", "source", "title", "metadata", "text").where(word(F.col("source")).isin(*sources) if sources else F.lit(True)))
    marked = has_headings(F.col("source"), F.col("metadata"), F.col("title"))
    return chunking.chunk_documents(d.select(F.col("row_id").cast("string").alias("document_id"), redact.redact(F.col("text")).alias("text"), marked.alias("markdown")))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all delivered documents, under their headings."""
    return packed_chunks(spark, sf_dir)


@query()
def dialogue_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all dialogues, put together from their chunks."""
    return chunking.dialogue_units(packed_chunks(spark, sf_dir, ("hermes", "claude", "codex", "grok")))


@query()
def distilled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the units, and their search texts."""
    made = distill.extract(dialogue_units(spark, sf_dir))
    return made.select("document_id", "unit", "input_hash", "first_ordinal", "last_ordinal", distill.flattened(F.col("distilled")).alias("search_text"))


@query()
def summary_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found by the summaries of their units, each with the chunk of the unit that fits the query best."""
    # Both the ranking and the lookup of its winners read the units; they are made once.
    units = write_once(distilled_units(spark, sf_dir), "units")
    rows = units.withColumn("chunk_pk", F.col("document_id").cast("long") * views.PLACES + F.col("unit")).select(
        "chunk_pk", "document_id", "first_ordinal", "last_ordinal", F.lit("").alias("title"), F.col("search_text").alias("content")
    )
    scores = lexical.bm25(rows, views.queries(spark)).withColumn("score", F.round("score", 9)).join(rows.select("chunk_pk", "document_id", "first_ordinal", "last_ordinal"), "chunk_pk")
    # Of a document's units the best, ties to the later.
    own = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), F.desc("chunk_pk"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_pk"))
    best = scores.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n").withColumn("rank", F.row_number().over(order)).where("rank <= 50")
    asked = views.queries(spark).withColumn("vector", embedding.hashed(F.col("query")))
    chunks = packed_chunks(spark, sf_dir).join(best.join(asked, "query_id"), "document_id").where("ordinal between first_ordinal and last_ordinal")
    near = chunks.withColumn("near", hybrid.dot(embedding.hashed(F.col("content")), F.col("vector")))
    return near.groupBy("query_id", "document_id", "rank").agg(F.max_by("ordinal", F.struct("near", -F.col("ordinal"))).alias("anchor_ordinal"))


@query()
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the search with the part of the text that answers best."""
    top = retrieval_queries.hybrid_search(spark, sf_dir).select("query_id", "position", "chunk_pk")
    text = views.indexed(spark, sf_dir).chunks.select("chunk_pk", "content").join(F.broadcast(top), "chunk_pk")
    words = views.queries(spark).select("query_id", lexical.query_words(F.col("query")).alias("words"))
    return text.join(F.broadcast(words), "query_id").select("query_id", "position", snippets.snippets(F.col("content"), F.col("words"), 200).alias("snippet"))


@query(
    f"with {views.BM25}, a as (select query_id, chunk_pk, round(score, 9) as score from scores), w as (select query_id, list(word) as words from words group by 1), "
    "s as (select query_id::int as query_id, chunk_pk, round(len(list_filter(words, lambda x: contains(lower(content), x)))::double / len(words), 6) as overlap, score from a join chunks using (chunk_pk) join w using (query_id)) "
    "select query_id, chunk_pk, overlap, row_number() over (partition by query_id order by overlap desc, score desc, chunk_pk) as place from s qualify place <= 20"
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of each query ordered anew by the share of the query's words they hold."""
    built = views.indexed(spark, sf_dir)
    chunks, scores = built.chunks, built.bm25(views.queries(spark)).withColumn("score", F.round("score", 9))
    words = views.queries(spark).select("query_id", lexical.query_words(F.col("query")).alias("words"))
    both = scores.join(chunks.select("chunk_pk", "content"), "chunk_pk").join(F.broadcast(words), "query_id")
    held = F.size(F.filter("words", lambda w: F.contains(F.lower("content"), w)))
    rated = both.withColumn("overlap", F.round(held / F.size("words"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc("score"), "chunk_pk")
    return rated.withColumn("place", F.row_number().over(order)).where("place <= 20").select("query_id", "chunk_pk", "overlap", "place")


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vectors of every vector whose id is divisible by 50, by the inverted file."""
    v = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * views.PLACES).alias("chunk_pk"), "embedding")
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return embedding.built(v, sf_dir, views.generation(spark, sf_dir, "embeddings")).search(queries, 50).select("query_id", "chunk_pk", "rank")


_TAGGED = [(1, "a <system-reminder>x\ny</system-reminder> b"), (2, "<tool_result id='1'>z</tool_result>ok"), (3, "<command-name>n</command-args> stays")]


def _sql_spoken() -> str:
    """redact.spoken() of `said`; without back-references each tag has a pattern of its own."""
    out = "said"
    for name in redact.SYNTHETIC.split("<(")[1].split(")")[0].split("|"):
        out = f"regexp_replace({out}, '(?is)<{name}\\b[^>]*>.*?</{name}>', '', 'g')"
    return f"trim({store_queries.sql_redacted(out)}, '{WHITE_SPACE}')"


_TAGGED_SQL = ", ".join("({}, '{}')".format(i, s.replace("'", "''").replace("\n", "' || chr(10) || '")) for i, s in _TAGGED)


@query(
    f"with said_rows as (select row_id + 1000 as id, content as said from hermes_messages where content is not null union all select * from (values {_TAGGED_SQL}) t(id, said)) "
    f"select id, {_sql_spoken()} as said from said_rows"
)
def clean_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without synthetic elements and secrets."""
    tagged = spark.createDataFrame(_TAGGED, "id long, said string")
    rows = table(spark, sf_dir, "hermes_messages").where("content is not null").select((F.col("row_id") + 1000).alias("id"), F.col("content").alias("said"))
    return rows.unionByName(tagged).select("id", redact.spoken(F.col("said")).alias("said"))
