"""A built collection: chunks, their inverted index, and the figures that ranking needs, kept as tables.

Postings lie in buckets by a hash of their term, sorted by term, so that a search reads the buckets of its own terms
and of these the row groups that hold them; lengths and document data come along, so that no search has to tokenise,
split or hash a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators import lexical
from loomstead.session import temporary

#: Buckets of postings, and parts that a bucket's rows are dealt to, so that a frequent term isn't one task's.
BUCKETS, PARTS = 64, 4
#: Terms of queries that are looked up by name; more are joined.
MOST_NAMED = 2_000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Collection:
    """Tables of one state of a collection under a folder: chunks, postings, figures."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        #: Tables by name, whose files are listed once.
        self._tables: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self._tables[name]

    @classmethod
    def build(cls, chunks: DataFrame, folder: str) -> Collection:
        """From (chunk_pk, document_id, ordinal, title, content, and any more columns); all rows and words are indexed."""
        spark = chunks.sparkSession
        tokens = lexical.lengths_and_tokens(chunks)
        tokens.drop("t_title", "t_content").write.parquet(f"{folder}/chunks")
        each = lexical.exploded(tokens).withColumn("bucket", bucket(F.col("term")))
        dealt = each.repartition("bucket", F.pmod(F.xxhash64("chunk_pk"), F.lit(PARTS))).sortWithinPartitions("bucket", "term", "chunk_pk")
        dealt.write.partitionBy("bucket").parquet(f"{folder}/postings")
        made = cls(spark, folder)
        made.chunks.agg(F.count("*").alias("n_chunks"), F.avg("n_tokens").alias("avg_tokens")).write.parquet(f"{folder}/figures")
        return made

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def figures(self) -> DataFrame:
        """One row: n_chunks, avg_tokens."""
        return self._table("figures")

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, chunk_pk, field, pos, n_tokens), all of them or those of some terms."""
        rows = self._table("postings")
        if terms is None:
            return rows
        named = [r.term for r in terms.select("term").distinct().limit(MOST_NAMED + 1).collect()]
        if len(named) > MOST_NAMED:
            return rows.join(terms.select("term", bucket(F.col("term")).alias("bucket")).distinct(), ["bucket", "term"], "left_semi")
        if not named:
            return rows.limit(0)
        # Folded to constants by the planner, so that other buckets aren't listed.
        within = F.array(*(bucket(F.lit(t)) for t in named))
        return rows.where(F.array_contains(within, F.col("bucket")) & F.col("term").isin(*named))

    def hits(self, queries: DataFrame, only: Column | None = None) -> DataFrame:
        terms = lexical.query_terms(queries)
        terms = terms.where(only) if only is not None else terms
        return lexical.phrase_hits(self.postings(terms), terms)

    def bm25(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_pk, score), larger is better; term weights and lengths are those of all chunks."""
        return lexical.scores(self.hits(queries), self.figures)


_BUILT: dict[tuple[str, str, tuple], Collection] = {}


def built(spark: SparkSession, chunks: Callable[[], DataFrame], name: str, state: tuple) -> Collection:
    """The collection of a name, built once in a session for each state of its source."""
    key = (spark.sparkContext.applicationId, name, state)
    if key not in _BUILT:
        _BUILT[key] = Collection.build(chunks(), temporary(spark, "collection"))
    return _BUILT[key]
