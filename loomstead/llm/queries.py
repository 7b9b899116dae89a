"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstead.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    from loomstead.llm.tokens import encode_column

    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def p8_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each mix, and how often each is used."""
    from loomstead.llm.mixing import compose

    drawn, _, _ = compose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return drawn


@_query
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked and actual shares of each mix's sources."""
    from loomstead.llm.mixing import compose, shares

    drawn, plan, _ = compose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return shares(drawn, plan)


@_query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document in runs of 200 or more that stand in another document."""
    from loomstead.llm.spans import shared_share

    return shared_share(table(spark, sf_dir, "documents"))


@_query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in which one is among the other's five most similar vectors, from cosine 0.85."""
    from loomstead.llm.neighbours import similar_pairs

    pairs = similar_pairs(table(spark, sf_dir, "chunk_vectors"))
    return pairs.selectExpr("a as chunk_pk_a", "b as chunk_pk_b")


@_query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message rows of the kept conversations with their turns."""
    from loomstead.llm.conversations import conversations

    return conversations(spark, sf_dir)


@_query
def p2_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of hermes_messages found again without their names, by replies and quotes planted between their rows.

    Each row replies to the one before it in its session, or, every third where that can be told from all other
    texts, quotes it instead. Rows of a session thus are one conversation, named by its least row.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from loomstead.llm.conversations import link_sessions

    rows = table(spark, sf_dir, "hermes_messages").where("session_id is not null").select("session_id", "seq", "row_id", "content")
    plain = rows.withColumn("content", F.when(F.col("content").rlike("(?m)^>"), None).otherwise(F.col("content")))
    # Texts that no other row has, on one line without outer blanks.
    lone = plain.where(F.col("content").rlike(r"^\S[^\n\r>]{18,}\S$")).groupBy("content").agg(F.count("*").alias("n"), F.max("row_id").alias("row_id")).where("n = 1").select("row_id", F.lit(True).alias("lone"))
    order = Window.partitionBy("session_id").orderBy("seq", "row_id")
    marked = plain.join(lone, "row_id", "left").select(
        "row_id", "seq", "content", F.lag("row_id").over(order).alias("before"), F.lag("content").over(order).alias("said"), F.lag("lone").over(order).alias("lone")
    )
    quotes = F.coalesce(F.col("lone"), F.lit(False)) & (F.col("row_id") % 3 == 0)
    name = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
    messages = marked.select(
        name("row_id").alias("message_id"), F.when(~quotes, name("before")).alias("reply_to"),
        F.when(quotes, F.concat(F.lit("> "), "said", F.lit("\n\n"), F.coalesce("content", F.lit("")))).otherwise(F.col("content")).alias("content"),
    )
    return link_sessions(messages).select(F.col("message_id").cast("long").alias("row_id"), F.col("conversation").cast("long").alias("conversation"))


ORACLE["p2_linked"] = "select row_id, min(row_id) over (partition by session_id) as conversation from hermes_messages where session_id is not null"


def split_documents(spark: SparkSession, sf_dir: str, limit: int = 1800, overlap: int = 200) -> DataFrame:
    """Pieces of the ingested documents over the limit: (row_id, ordinal, breadcrumb, piece)."""
    from pyspark.sql import functions as F

    from loomstead.functions.text import strip, unix_lines
    from loomstead.llm.splitting import split_texts
    from loomstead.operators.headings import has_headings

    docs = table(spark, sf_dir, "ingest_documents")
    long = docs.where(F.length(strip(unix_lines(F.col("text")))) > limit)
    marked = has_headings(F.col("source"), F.col("metadata"), F.col("title"))
    return split_texts(long.select("row_id", "text", marked.alias("markdown")), limit, overlap)


@_query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumbs of the pieces of each document over the limit."""
    return split_documents(spark, sf_dir).select("row_id", "breadcrumb").distinct()


@_query
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document over the limit."""
    return split_documents(spark, sf_dir)


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families and clean text of the ingested documents and the messages: (tbl, row_id, families, clean)."""
    from pyspark.sql import functions as F

    from loomstead.llm.markup import clean_markup

    host = F.nullif(F.regexp_extract(F.coalesce("uri", F.lit("")), r"^(?i)https?://([^/?#]+)", 1), F.lit(""))
    docs = table(spark, sf_dir, "ingest_documents").select(F.lit("ingest_documents").alias("tbl"), "row_id", "text", host.alias("host"))
    said = table(spark, sf_dir, "hermes_messages").select(
        F.lit("hermes_messages").alias("tbl"), "row_id", F.col("content").alias("text"), F.lit(None).cast("string").alias("host")
    )
    return clean_markup(docs.unionByName(said))


@_query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup families of each row."""
    from pyspark.sql import functions as F

    return cleaned_texts(spark, sf_dir).select("tbl", "row_id", F.explode("families").alias("family"))


@_query
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without markup."""
    return cleaned_texts(spark, sf_dir).select("tbl", "row_id", "clean")


@_query
def p6_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of all documents, one host for each source: what the pages of a host repeat goes, what varies stays."""
    from pyspark.sql import functions as F

    from loomstead.llm.markup import clean_markup

    page = F.concat(
        F.lit('<!doctype html><html><head><title>Site</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/about">About us</a></li></ul></nav><main><h1>Note '),
        F.col("doc_id").cast("string"), F.lit("</h1><p>Written in <b>"), F.coalesce("project", F.lit("no project")), F.lit("</b> with "), F.coalesce(F.col("n_chars").cast("string"), F.lit("no")),
        F.lit(" characters as number "), F.col("doc_id").cast("string"), F.lit(".</p></main><footer>All rights reserved by "), F.col("source"), F.lit("</footer></body></html>"),
    )
    docs = table(spark, sf_dir, "documents").where("source is not null and doc_id is not null")
    return clean_markup(docs.select("doc_id", page.alias("text"), F.col("source").alias("host"))).select("doc_id", "clean")


ORACLE["p6_template"] = (
    "select doc_id, '# Note ' || doc_id || chr(10) || chr(10) || ' ' || coalesce(project, 'no project') || ' with ' || coalesce(n_chars::varchar, 'no') || ' characters as number ' || doc_id || '.' as clean "
    "from documents where source is not null and doc_id is not null"
)
