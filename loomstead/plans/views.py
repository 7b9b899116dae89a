"""The driver's tables in the engine's terms, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.text import stable_id
from loomstead.operators.lexical import ACCENTED, PLAIN, STOPWORDS
from loomstead.operators import collection
from loomstead.session import table

#: A chunk's key is its document's times this, which no text has as many paragraphs as, plus its place.
PLACES = 1 << 30
#: The time that recency counts from.
NOW = "2026-08-01 00:00:00"
QUERIES = [(1, "the stale lease and the ranking floor"), (2, "re-embedded shared footer"), (3, "migration runner timed out on citations"), (4, "le verrou et la fenêtre")]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    return d.select(
        "doc_id",
        stable_id("doc", F.col("source"), F.col("doc_id").cast("string")).alias("document_id"),
        "source",
        "kind",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        "text",
        "project",
        F.col("timestamp").alias("ts"),
        F.sha2("text", 256).alias("content_hash"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs as chunks, numbered within their document."""
    parts = docs(spark, sf_dir).select("doc_id", "document_id", "title", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("ordinal", "content"))
    return parts.where("trim(content) <> ''").withColumn("chunk_pk", F.col("doc_id") * PLACES + F.col("ordinal"))


def indexed(spark: SparkSession, sf_dir: str) -> collection.Collection:
    """The documents' chunks with their index, built when they are first searched and again when their files change."""

    def rows() -> DataFrame:
        return chunks(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "source", "project", "ts"), "doc_id")

    return collection.built(spark, rows, sf_dir, generation(spark, sf_dir, "documents"))


def generation(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """The files of a table with their sizes and times: what is built from it is built again when they change."""
    state = table(spark, sf_dir, name)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in state.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, query string")


DOCS = """docs as (
  select doc_id, 'doc_' || substr(sha256(source || chr(0) || doc_id::varchar), 1, 32) as document_id, source, kind,
         coalesce(title, 'Untitled') as title, "text", project, "timestamp" as ts, sha256("text") as content_hash
  from documents where "text" is not null and "text" <> '')"""
CHUNKS = DOCS + r""", parts as (
  select doc_id, document_id, title, string_split_regex("text", '\n[ \t]*\n') as p from docs), chunks as (
  select doc_id, document_id, title, i - 1 as ordinal, p[i] as content, doc_id * 1073741824 + i - 1 as chunk_pk
  from (select *, unnest(range(1, len(p) + 1)) as i from parts) where trim(p[i], ' ') <> '')"""
TOKENS = rf"regexp_extract_all(translate(lower(coalesce({{}}, '')), '{ACCENTED}', '{PLAIN}'), '[\p{{{{L}}}}\p{{{{N}}}}]+')"


def tokens_sql(c: str) -> str:
    return TOKENS.replace("{{", "{").replace("}}", "}").replace("{}", c)


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
QUERY_SQL = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)
BM25 = (
    CHUNKS
    + f""", queries(query_id, query) as (values {QUERY_SQL}), words as (
  select query_id, i - 1 as phrase_id, w[i] as word from (
    select query_id, w, unnest(range(1, len(w) + 1)) as i from (
      select query_id, list_distinct_in_order as w from (
        select query_id, list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_''-]+'), lambda x: x not in ({_STOP})) as list_distinct_in_order from queries)))),
 qt as (select query_id, phrase_id, len(t) as places, i - 1 as place, t[i] as term from (
    select query_id, phrase_id, t, unnest(range(1, len(t) + 1)) as i from (select query_id, phrase_id, {tokens_sql("word")} as t from words))),
 fields as (select chunk_pk, 'title' as field, {tokens_sql("title")} as t from chunks
    union all select chunk_pk, 'content', {tokens_sql("content")} from chunks),
 posting as (select chunk_pk, field, i - 1 as pos, t[i] as term from (select chunk_pk, field, t, unnest(range(1, len(t) + 1)) as i from fields)),
 sizes as (select chunk_pk, sum(len(t)) as n_tokens from fields group by 1),
 whole as (select count(*) as n_chunks, avg(n_tokens) as avg_tokens from sizes),
 spots as (select query_id, phrase_id, places, chunk_pk, field, pos - place as spot, count(*) as n from posting join qt using (term)
    group by all having count(*) = places),
 hits as (select query_id, phrase_id, chunk_pk, sum(case when field = 'title' then 2.0 else 1.0 end)::double as tf from spots group by all),
 idfs as (select query_id, phrase_id, avg_tokens, case when ln((n_chunks - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((n_chunks - n + 0.5) / (n + 0.5)) end as idf
    from (select query_id, phrase_id, count(*) as n from hits group by all), whole),
 scores as (select query_id, chunk_pk, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens))) as score
    from hits join idfs using (query_id, phrase_id) join sizes using (chunk_pk) group by all),
 lexical as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pk) as rank from scores) where rank <= 50)"""
)
