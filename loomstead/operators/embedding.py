"""A deterministic hashing embedder, and an inverted-file index over vectors."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators import hybrid, lexical
from loomstead.session import temporary

#: Vectors that centres are learned from, vectors of a centre at least, and rounds of learning.
SAMPLE, OF_CENTRE, ROUNDS = 8_192, 8, 12
#: Vectors by which it is found how many lists a search must read for this recall.
TRIED, RECALL = 64, 0.97
_WORD = re.compile(r"[\w'-]+")


def hashed_vector(text: str, dims: int) -> np.ndarray:
    """Signed counts of hashed words, of unit length; all zero without words."""
    out = np.zeros(dims, np.float32)
    for w in _WORD.findall(text.casefold()):
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % dims] += 1 if h[4] & 1 else -1
    size = float(np.linalg.norm(out))
    return out / size if size else out


def hashed(text: Column, dims: int = 64) -> Column:
    """hashed_vector() of a column; null stays null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashed_vector(t, dims).tolist() for t in texts])

    return run(text)


class InvertedFile:
    """Vectors by their nearest centre, in a table partitioned by it: a search reads the lists nearest to its query.

    Centres, as many as the root of the number of vectors (while the sample has OF_CENTRE for each), are learned from
    at most SAMPLE vectors; every vector is in the index. `probes` is the least number of lists that holds RECALL of
    the k nearest of TRIED vectors, found by an exact search for these.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, folder: str | None = None, k: int = 50):
        self.spark: SparkSession = vectors.sparkSession
        rows = vectors.select("chunk_pk", "embedding").where("embedding is not null")
        sample = rows.orderBy(F.xxhash64("chunk_pk"), "chunk_pk").limit(SAMPLE).collect()
        if lists is None:
            lists = max(1, min(int(rows.count() ** 0.5), len(sample) // OF_CENTRE))
        self.centres = _centres(np.array([r.embedding for r in sample], np.float32), lists)
        self.path = f"{folder or temporary(self.spark, 'lists')}/lists-{uuid.uuid4().hex}"
        centres = self.centres

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.array(b["embedding"].tolist(), np.float32)
                    yield b.assign(list=np.argmax(x @ centres.T, axis=1).astype(np.int32))

        placed = rows.mapInPandas(place, "chunk_pk long, embedding array<float>, list int")
        placed.repartition("list").write.partitionBy("list").parquet(self.path)
        self.k, self.probes = k, self._tried(rows, sample[:TRIED], k)

    def _tried(self, rows: DataFrame, sample: list, k: int) -> int:
        if not sample:
            return 1
        asked = self.spark.createDataFrame([(r.chunk_pk, r.embedding) for r in sample], "query_id long, vector array<float>")
        top = hybrid.exact_topk(rows, asked, k)
        lists = self.spark.read.parquet(self.path).select("chunk_pk", "list")
        # At most k rows of each of the few that are tried.
        held = top.join(lists, "chunk_pk").select("query_id", "list").toPandas()
        order = {r.chunk_pk: np.argsort(np.argsort(-(np.array(r.embedding, np.float32) @ self.centres.T))) for r in sample}
        place = np.sort([order[q][c] for q, c in zip(held["query_id"], held["list"])])
        return int(place[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)]) + 1 if len(place) else 1

    def search(self, queries: DataFrame, k: int = 50, probes: int | None = None) -> DataFrame:
        """(query_id, chunk_pk, score, rank) of the k best in the probed lists, for any number of (query_id, vector).

        Queries stay a table: each is dealt to its lists and joined with them there. Those without a vector find nothing.
        """
        centres, probes = self.centres, probes or self.probes

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.array(b["vector"].tolist(), np.float32)
                    near = np.argsort(-(x @ centres.T), axis=1)[:, :probes].astype(np.int32)
                    yield b.assign(list=near.tolist())

        asked = queries.select("query_id", "vector").where("vector is not null")
        kind = asked.schema["query_id"].dataType.simpleString()
        probed = asked.mapInPandas(probe, f"query_id {kind}, vector array<float>, list array<int>").withColumn("list", F.explode("list"))
        stored = self.spark.read.parquet(self.path)
        scored = stored.join(probed, "list").select("query_id", "chunk_pk", hybrid.dot(F.col("embedding"), F.col("vector")).alias("score"))
        return lexical.ranked(scored.withColumn("score", F.round("score", 9)), k, F.desc("chunk_pk"))


def _centres(x: np.ndarray, lists: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                mean = x[near == c].mean(0)
                centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centres


_BUILT: dict[tuple, InvertedFile] = {}


def built(vectors: DataFrame, name: str, generation: object, k: int = 50) -> InvertedFile:
    """The index of a name, built once in a session for each generation of its vectors."""
    key = (vectors.sparkSession.sparkContext.applicationId, name, generation, k)
    if key not in _BUILT:
        _BUILT[key] = InvertedFile(vectors, folder=temporary(vectors.sparkSession, "lists"), k=k)
    return _BUILT[key]
