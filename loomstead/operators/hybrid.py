"""Vector ranking, fusion of channels, and results by document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The constant of rank fusion, and the floor, span and days of recency.
RRF_K, RECENCY_FLOOR, RECENCY_SPAN, RECENCY_DAYS = 60, 0.7, 0.3, 180.0

#: Queries that are asked in one pass over the vectors.
QUERIES = 4_096


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_pk, score) of (chunk_pk, embedding) against the few vectors of (query_id, vector)."""
    return vectors.join(F.broadcast(queries)).select("query_id", "chunk_pk", dot(F.col("embedding"), F.col("vector")).alias("score"))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, by: str | None = None, block: int = QUERIES) -> DataFrame:
    """(query_id, chunk_pk, score, rank), and `by` if given: the k most similar vectors of each query, or of each query and value of `by`.

    All of (query_id, vector) are asked against all of (chunk_pk, embedding). Queries go over the vectors in blocks of
    about `block`, one pass each, as a matrix; a task gives k rows of a query at most. Scores are rounded to 9 decimals,
    ties go to the larger chunk_pk. Null vectors and those of another length than the query's have no score.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    of = f", `{by}` {vectors.schema[by].dataType.simpleString()}" if by else ""
    rows = vectors.select("chunk_pk", "embedding", *([by] if by else [])).where("embedding is not null and chunk_pk is not null")
    asked = queries.select("query_id", "vector").where("vector is not null and query_id is not null")
    parts = max(1, -(-asked.count() // block))
    out = None
    for n in range(parts):
        # About a block of queries, by a hash of their ids.
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n).collect()
        one = _best_of_tasks(rows, [(r.query_id, r.vector) for r in some], k, by, f"query_id {kind}, chunk_pk long, score double{of}")
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), F.desc("chunk_pk"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best_of_tasks(rows: DataFrame, asked: list[tuple], k: int, by: str | None, schema: str) -> DataFrame:
    names = [x.split()[0].strip("`") for x in schema.split(", ")]
    groups: dict[int, tuple[list, list]] = {}
    for q, v in asked:
        ids, held = groups.setdefault(len(v), ([], []))
        ids.append(q)
        held.append(v)
    matrices = {d: (ids, np.array(held, np.float64)) for d, (ids, held) in groups.items()}

    def best(ids: list, scores: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
        for q, own in zip(ids, scores):
            order = np.lexsort((-keys, -own))[:k]
            yield from ((q, int(keys[i]), float(own[i])) for i in order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            vectors = batch.column("embedding").to_pylist()
            size = np.array([len(v) for v in vectors], np.int64)
            values = np.array(batch.column(by).to_pylist(), object) if by else None
            keys = batch.column("chunk_pk").to_numpy()
            for d in np.unique(size):
                if int(d) not in matrices:
                    continue
                ids, asked_ = matrices[int(d)]
                which = np.flatnonzero(size == d)
                scores = np.round(asked_ @ np.array([vectors[i] for i in which], np.float64).T, 9)
                if by is None:
                    made += best(ids, scores, keys[which])
                    continue
                for value in dict.fromkeys(values[which].tolist()):
                    own = np.flatnonzero([x == value for x in values[which]])
                    made += ((*r, value) for r in best(ids, scores[:, own], keys[which[own]]))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    spark = rows.sparkSession
    types = [f.type for f in spark.createDataFrame([], schema).toArrow().schema]
    return rows.mapInArrow(run, schema)


def fuse(*channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_pk, rrf) of channels (query_id, chunk_pk, rank): the sum of 1/(k + rank) over those that have it."""
    every = channels[0].select("query_id", "chunk_pk", "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select("query_id", "chunk_pk", "rank"))
    return every.groupBy("query_id", "chunk_pk").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def recency(ts: Column, now: Column) -> Column:
    """How much age lowers a score: never below the floor."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0))
    return RECENCY_FLOOR + RECENCY_SPAN * F.exp(-days / RECENCY_DAYS)


def best_of_each_document(scored: DataFrame, limit: int = 20) -> DataFrame:
    """The best chunk of each document and of those the best: ties go to the smaller chunk_pk."""
    own = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), F.asc("chunk_pk"))
    best = scored.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_pk"))
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def variants(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each anchor with its neighbour before (previous), after (next), or alone: (.., direction, chunk_pks)."""
    near = chunks.select("document_id", F.col("ordinal").alias("near_ordinal"), F.col("chunk_pk").alias("near_pk"))
    pairs = anchors.select("query_id", "document_id", "chunk_pk", "ordinal").join(near, "document_id")
    pairs = pairs.where(F.abs(F.col("near_ordinal") - F.col("ordinal")) == 1)
    sides = pairs.select(
        "query_id",
        "document_id",
        F.when(F.col("near_ordinal") < F.col("ordinal"), "previous").otherwise("next").alias("direction"),
        F.when(F.col("near_ordinal") < F.col("ordinal"), F.array("near_pk", "chunk_pk")).otherwise(F.array("chunk_pk", "near_pk")).alias("chunk_pks"),
        F.col("near_pk"),
    )
    alone = anchors.join(sides.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_anti")
    alone = alone.select(
        "query_id", "document_id", F.lit("anchor").alias("direction"), F.array("chunk_pk").alias("chunk_pks"), F.lit(None).cast("long").alias("near_pk")
    )
    return sides.unionByName(alone)


def fallback_variant(made: DataFrame, scores: DataFrame) -> DataFrame:
    """Of each document's variants that with the better-scored neighbour (none: -1), then the one that reads on."""
    known = made.join(scores.select("query_id", F.col("chunk_pk").alias("near_pk"), F.col("score").alias("near")), ["query_id", "near_pk"], "left")
    order = Window.partitionBy("query_id", "document_id").orderBy(
        F.desc(F.coalesce("near", F.lit(-1.0))), F.desc((F.col("direction") == "next").cast("int"))
    )
    return known.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "near")


def passage(content: Column, words: Column, length: int | Column) -> Column:
    """A window of the text a third before the first word found, with marks where it is cut."""
    places = F.filter(F.transform(words, lambda w: F.position(w, F.lower(content))), lambda p: p > 0)
    length = (F.lit(length) if isinstance(length, int) else length).cast("int")
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places) - 1, F.lit(0)) - F.floor(length / 3).cast("int"))
    cut = F.substr(content, start + 1, length)
    marked = F.concat(
        F.when(start > 0, "…").otherwise(""), F.trim(cut), F.when(start + length < F.length(content), "…").otherwise("")
    )
    return F.when(F.length(content) <= length, content).otherwise(marked)


def passages(made: DataFrame, chunks: DataFrame, words: DataFrame, budget: int = 700) -> DataFrame:
    """Of each variant what a reranker reads: its chunks' passages, which share the budget, with a blank line between.

    made: variants(); chunks: (chunk_pk, content); words: (query_id, words).
    """
    each = made.select("query_id", "document_id", "direction", F.size("chunk_pks").alias("n"), F.posexplode("chunk_pks").alias("i", "chunk_pk"))
    # Variants of some twenty documents of each query.
    known = chunks.select("chunk_pk", "content").join(F.broadcast(each), "chunk_pk").join(F.broadcast(words), "query_id")
    share = F.greatest(F.lit(100), F.floor(F.lit(budget) / F.col("n")))
    parts = known.withColumn("_p", passage(F.col("content"), F.col("words"), share))
    joined = parts.groupBy("query_id", "document_id", "direction").agg(F.array_sort(F.collect_list(F.struct("i", "_p"))).alias("p"))
    return joined.select("query_id", "document_id", "direction", F.array_join(F.transform("p", lambda x: x["_p"]), "\n\n").alias("passage"))


def best_variant(scored: DataFrame) -> DataFrame:
    """Of each document the variant with the best rerank_score; of equals what comes before the anchor, then what follows."""
    place = F.when(F.col("direction") == "previous", 0).when(F.col("direction") == "next", 1).otherwise(2)
    order = Window.partitionBy("query_id", "document_id").orderBy(F.desc_nulls_last("rerank_score"), place)
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def final_order(results: DataFrame, limit: int) -> DataFrame:
    """Add `position`: by rerank_score where there is one, else by retrieval_score, then by that, then by document; the limit is 1 to 20."""
    first = F.coalesce("rerank_score", "retrieval_score")
    order = Window.partitionBy("query_id").orderBy(F.desc(first), F.desc("retrieval_score"), "document_id")
    return results.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max(1, min(20, limit)))


def filters(sources: list[str] | None = None, project: str | None = None, since: Column | None = None) -> Column:
    """Whether a row is of one of the sources (regardless of case and outer blanks), of the project, and not older; none is no filter."""
    out = F.lit(True)
    if sources:
        out = out & F.col("source").isin(*(s.strip().casefold() for s in sources))
    if project is not None:
        out = out & (F.col("project") == project)
    return out & (F.col("ts") >= since) if since is not None else out
