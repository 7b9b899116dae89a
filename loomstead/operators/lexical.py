"""Full-text ranking: tokens with places, phrases, and BM25 over the whole collection."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# BM25's constants, the weights of the fields, the least weight of a term, and the most terms of a query.
K1, B, TITLE_WEIGHT, CONTENT_WEIGHT, LEAST_IDF, MOST_TERMS = 1.2, 0.75, 2.0, 1.0, 1e-6, 24
# Letters that are another letter with marks, by their canonical decomposition, and that letter; the marks themselves have none and go.
_MARKS = [chr(c) for c in range(0x300, 0x370)]
_MARKED = {chr(c): d[0] for c in range(0xC0, 0x2000) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and chr(c).islower() and all(m in _MARKS for m in d[1:])}
ACCENTED, PLAIN = "".join([*_MARKED, *_MARKS]), "".join(_MARKED.values())
# Words that carry no meaning for a query.
STOPWORDS = (
    "a about after all also am an and any are as at be because been before being but by can cannot could did do does doing done down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no "
    "nor not of off on once only or other our out over own same she should so some such than that the their them then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with would you your"
).split()


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(text: Column) -> Column:
    """Distinct words of a query in order, without stopwords unless there is nothing else."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)))
    strong = F.array_except(words, F.array(*map(F.lit, STOPWORDS)))
    return F.when(F.size(strong) > 0, strong).otherwise(words)


def query_terms(queries: DataFrame) -> DataFrame:
    """From (query_id, query) to (query_id, phrase_id, places, place, term): each word is a phrase of its tokens."""
    words = queries.select("query_id", F.posexplode(query_words(F.col("query"))).alias("phrase_id", "word"))
    parts = words.select("query_id", "phrase_id", tokens(F.col("word")).alias("t")).where(F.size("t") > 0)
    return parts.select("query_id", "phrase_id", F.size("t").alias("places"), F.posexplode("t").alias("place", "term"))


def lengths_and_tokens(chunks: DataFrame) -> DataFrame:
    """Add the tokens of both fields and `n_tokens`, those of title and content together."""
    both = chunks.withColumn("t_title", tokens(F.col("title"))).withColumn("t_content", tokens(F.col("content")))
    return both.withColumn("n_tokens", F.size("t_title") + F.size("t_content"))


def exploded(tokenised: DataFrame) -> DataFrame:
    """(term, chunk_pk, field, pos, n_tokens) of all tokens."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"t_{f}").alias("t")) for f in ("title", "content")))
    each = tokenised.select("chunk_pk", "n_tokens", F.explode(fields).alias("f"))
    return each.select(F.posexplode("f.t").alias("pos", "term"), "chunk_pk", F.col("f.field").alias("field"), "n_tokens").select("term", "chunk_pk", "field", "pos", "n_tokens")


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_pk, field, pos, n_tokens) of all tokens of (chunk_pk, title, content)."""
    return exploded(lengths_and_tokens(chunks))


def phrase_hits(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, phrase_id, chunk_pk, tf, n_tokens) of postings: weighted hits of each phrase; its terms must follow each other in one field.

    The terms of the queries are few; those postings alone are kept before anything is grouped.
    """
    found = rows.join(F.broadcast(terms), "term")
    at = (F.col("pos") - F.col("place")).alias("at")
    whole = found.groupBy("query_id", "phrase_id", "places", "chunk_pk", "field", at).agg(F.count("*").alias("n"), F.max("n_tokens").alias("n_tokens"))
    weight = F.when(F.col("field") == "title", TITLE_WEIGHT).otherwise(CONTENT_WEIGHT)
    return whole.where("n = places").groupBy("query_id", "phrase_id", "chunk_pk").agg(F.sum(weight).alias("tf"), F.max("n_tokens").alias("n_tokens"))


def scores(hits: DataFrame, whole: DataFrame) -> DataFrame:
    """(query_id, chunk_pk, score) of hits; whole: one row of n_chunks and avg_tokens of the collection."""
    # One row for each phrase of a query, and one row.
    weights = hits.groupBy("query_id", "phrase_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(whole))
    idf = F.log((F.col("n_chunks") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = weights.select("query_id", "phrase_id", "avg_tokens", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))
    joined = hits.join(F.broadcast(weights), ["query_id", "phrase_id"])
    norm = K1 * (1 - B + B * F.col("n_tokens") / F.col("avg_tokens"))
    return joined.groupBy("query_id", "chunk_pk").agg(F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("score"))


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_pk, score) of chunks without an index, larger is better; term weights and lengths are those of all chunks given.

    Chunks without any term of the queries aren't exploded.
    """
    terms = query_terms(queries)
    tokenised = lengths_and_tokens(chunks)
    asked = F.broadcast(terms.agg(F.collect_set("term").alias("asked")))
    some = tokenised.join(asked).where(F.arrays_overlap("t_title", "asked") | F.arrays_overlap("t_content", "asked"))
    whole = tokenised.agg(F.count("*").alias("n_chunks"), F.avg("n_tokens").alias("avg_tokens"))
    return scores(phrase_hits(exploded(some), terms), whole)


def ranked(scores: DataFrame, limit: int, tie: Column | None = None) -> DataFrame:
    """Add `rank` and keep the best of each query; ties go to the smaller chunk_pk unless said otherwise."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_pk") if tie is None else tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def capped_terms(queries: DataFrame, frequency: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """Of each query the rarest words: (query_id, word, n, kept_rank); unknown words count as rarest, ties keep their order."""
    words = queries.select("query_id", F.posexplode(query_words(F.col("query"))).alias("at", "word"))
    known = words.join(frequency.select(F.col("term").alias("word"), "n"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("query_id").orderBy("n", "at")
    return known.withColumn("kept_rank", F.row_number().over(order)).where(F.col("kept_rank") <= most).drop("at")
