from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead import settings
from loomstead.operators import evaluation, hybrid, models


def test_settings(tmp_path, monkeypatch):
    assert settings.Settings(candidate_limit=5000, chunk_size=1, reconcile_min_ratio=-1.0).__dict__.items() >= {"candidate_limit": 200, "chunk_size": 400, "reconcile_min_ratio": 0.0}.items()
    assert {n: settings.within(n, d) for n, (d, *_) in settings.LIMITS.items()} == {n: d for n, (d, *_) in settings.LIMITS.items()}
    assert {n: getattr(settings.Settings(), n) for n in settings.LIMITS} == {n: d for n, (d, *_) in settings.LIMITS.items()}
    file = tmp_path / "s.json"
    file.write_text(json.dumps({"rrf_k": 0, "vector_backend": "exact"}))
    monkeypatch.setenv("LOOMSTEAD_FOLDER", "/x")
    got = settings.load(file)
    assert (got.rrf_k, got.vector_backend, got.folder) == (1, "exact", "/x") and settings.load(tmp_path / "none").rrf_k == 60
    for bad in ([1], {"nothing": 1}, {"vector_backend": "other"}):
        file.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            settings.load(file)


def test_protocols():
    assert isinstance(models.HashingEmbedder(), models.Embedder) and isinstance(models.OverlapReranker(), models.Reranker)
    assert isinstance(models.ExtractiveDistiller(), models.Distiller)
    assert models.HashingEmbedder(16).embed(["a", ""]).shape == (2, 16) and models.HashingEmbedder(16).embed([]).shape == (0, 16)


def test_batches_of_like_lengths():
    assert list(models.in_batches([5, 1, 3, 1], 2)) == [[1, 3], [2, 0]] and list(models.in_batches([], 8)) == []


def test_models_as_columns(spark):
    class Marker:
        model_name = "marker"
        asked: list = []

        def score(self, query, passages):
            return [float(p.count(query)) for p in passages]

    rows = [("a", "aaa"), ("b", "ab"), ("a", ""), (None, "x"), ("a", None), ("a", "ba")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, p string").coalesce(1)
    got = df.select("i", models.reranked(F.col("q"), F.col("p"), Marker(), 2).alias("s"), models.embedded(F.col("p"), models.HashingEmbedder(8)).alias("v")).orderBy("i").collect()
    assert [r.s for r in got] == [3.0, 1.0, 0.0, None, None, 1.0]
    assert [r.v is None for r in got] == [False, False, False, False, True, False] and np.isclose(np.linalg.norm(got[0].v), 1)


def test_final_order_and_best_variant(spark):
    rows = [(1, "d1", "previous", 0.5, 0.1), (1, "d1", "next", 0.5, 0.1), (1, "d2", "anchor", 0.9, 0.2), (1, "d0", "anchor", 0.5, 0.1)]
    df = spark.createDataFrame(rows, "query_id int, document_id string, direction string, rerank_score double, retrieval_score double")
    best = hybrid.best_variant(df)
    got = [(r.document_id, r.direction) for r in hybrid.final_order(best, 99).orderBy("position").collect()]
    assert got == [("d2", "anchor"), ("d0", "anchor"), ("d1", "previous")]
    plain = best.withColumn("rerank_score", F.lit(None).cast("double"))
    assert [r.document_id for r in hybrid.final_order(plain, 0).collect()] == ["d2"]


def test_suites():
    good = {"version": "1", "cases": [{"id": "a", "query": "q"}]}
    assert evaluation.checked_suite(good) is good and len(evaluation.suite_hash(good)) == 64
    for bad in ([], {"cases": good["cases"]}, {"version": "1", "cases": []}, {"version": "1", "cases": good["cases"] * 2}, {"version": "1", "cases": [{"id": "a", "query": " "}]}, {"version": "1", "cases": ["a"]}):
        with pytest.raises(ValueError):
            evaluation.checked_suite(bad)


def test_exact_topk_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 6)).round(2)
    x[50] = x[10]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(200, None, 0), (201, [1.0], 1)]
    vectors = spark.createDataFrame(rows, "chunk_pk long, embedding array<double>, label int").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 120, 10)] + [(999, None)], "query_id long, vector array<double>")
    got = {(r.query_id, r["rank"]): r.chunk_pk for r in hybrid.exact_topk(vectors, queries, 4, block=5).collect()}
    want = {}
    for q in range(0, 120, 10):
        s = np.round(x @ x[q], 9)
        for n, i in enumerate(np.lexsort((-np.arange(120), -s))[:4], 1):
            want[q, n] = i
    assert got == want
    by = hybrid.exact_topk(vectors, queries, 2, "label", block=5).groupBy("query_id", "label").count().collect()
    assert len(by) == 36 and {r["count"] for r in by} == {2}
    assert hybrid.exact_topk(vectors, queries.limit(0), 3).count() == 0


def test_tables_are_discarded(spark):
    import os

    from loomstead.session import discard, write_once

    df = write_once(spark.range(3), "some")
    path = df._written_at.removeprefix("file:")
    assert os.path.isdir(path)
    discard(df)
    discard(spark.range(2))
    assert not os.path.isdir(path)
