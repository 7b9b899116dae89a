"""Retrieval quality: metrics, gates and canaries."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Floors of the gate, and how much a metric may fall.
CITATION = "loomstead://document/"
FLOORS = {"recall_at_8": 1.0, "recall_at_20": 1.0, "mrr_at_8": 0.78, "ndcg_at_10": 0.83}
TOLERANCE = 1e-6


def case_metrics(ranking: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, recall_at_8, recall_at_20, mrr_at_8, ndcg_at_10) of (query_id, document_id, position) by (.., gain).

    Gains of 0 or less don't count as relevant; a query without relevant documents scores 0.
    """
    good = judged.where("gain > 0")
    hit = ranking.join(good, ["query_id", "document_id"])
    got = hit.groupBy("query_id").agg(
        F.count_if(F.col("position") <= 8).alias("in8"),
        F.count_if(F.col("position") <= 20).alias("in20"),
        F.min("position").alias("first"),
        F.sum(F.when(F.col("position") <= 10, F.col("gain") / F.log2(F.col("position") + 1))).alias("dcg"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "document_id")
    ideal = good.withColumn("n", F.row_number().over(order)).groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("n") <= 10, F.col("gain") / F.log2(F.col("n") + 1))).alias("idcg")
    )
    queries = ranking.select("query_id").unionByName(judged.select("query_id")).distinct()
    joined = queries.join(ideal, "query_id", "left").join(got, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.col(b), F.lit(0.0))
    return joined.select(
        "query_id",
        ratio("in8", "relevant").alias("recall_at_8"),
        ratio("in20", "relevant").alias("recall_at_20"),
        F.when(F.col("first") <= 8, 1.0 / F.col("first")).otherwise(0.0).alias("mrr_at_8"),
        ratio("dcg", "idcg").alias("ndcg_at_10"),
    )


def means(cases: DataFrame) -> DataFrame:
    """One row (metric, value) for each metric."""
    one = cases.agg(*(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in FLOORS))
    return one.unpivot([], list(FLOORS), "metric", "value")


def gate(measured: DataFrame, reference: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Add what each metric was and whether it fell by more than the tolerance."""
    joined = measured.join(reference.select("metric", F.col("value").alias("was")), "metric")
    return joined.withColumn("regressed", F.col("value") - F.col("was") < -tolerance)


def floors(measured: DataFrame) -> DataFrame:
    """Add each metric's floor and whether it is broken."""
    known = F.create_map(*(F.lit(x) for kv in FLOORS.items() for x in kv))
    return measured.withColumn("floor", known[F.col("metric")]).withColumn("broken", F.col("value") < F.col("floor"))


def nearest_rank(column: str, share: float) -> Column:
    """The value of a column at rank ceil(share * n)."""
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


def canary_failures(expected: DataFrame, ranking: DataFrame) -> DataFrame:
    """(query_id, failures): what each case finds wrong with its ranking (query_id, document_id, position, source).

    expected: query_id, document_id or null, baseline_rank, rank_tolerance, expected_empty, forbidden_source, and
    optionally forbidden_document, project (all results must be of it), latency_ms and most_ms. The ranking optionally
    has project, citation and taints.
    """
    want = ranking.select("query_id", "document_id", "position")
    found = expected.join(want, ["query_id", "document_id"], "left").select("query_id", "document_id", "position", *[c for c in expected.columns if c not in ("query_id", "document_id")])
    more = [F.collect_set(c).alias(f"{c}s") for c in ("project",) if c in ranking.columns]
    if "citation" in ranking.columns:
        more.append(F.bool_and(F.coalesce(F.col("citation").startswith(CITATION), F.lit(False))).alias("cited"))
    if "taints" in ranking.columns:
        more.append(F.bool_and(F.coalesce(F.array_contains("taints", "untrusted_evidence"), F.lit(False))).alias("flagged"))
    # A ranking has at most some twenty rows of a query.
    whole = ranking.groupBy("query_id").agg(
        F.count("*").alias("results"), F.countDistinct("document_id").alias("distinct_results"), F.collect_set("source").alias("sources"),
        F.collect_set("document_id").alias("documents"), *more,
    )
    joined = found.join(whole, "query_id", "left")
    n = F.coalesce("results", F.lit(0))
    has = lambda c: c in joined.columns
    no = F.lit(None).cast("string")
    failures = F.array_compact(
        F.array(
            F.when(F.col("expected_empty") & (n > 0), "expected_empty"),
            F.when(F.col("document_id").isNotNull() & F.col("position").isNull(), "expected_document_missing"),
            F.when(F.col("position") - F.col("baseline_rank") > F.col("rank_tolerance"), "rank_regression"),
            F.when(F.array_contains("sources", F.col("forbidden_source")), "forbidden_source_returned"),
            F.when(n != F.coalesce("distinct_results", F.lit(0)), "duplicate_documents"),
            F.when(F.array_contains("documents", F.col("forbidden_document")), "forbidden_document_returned") if has("forbidden_document") else no,
            F.when(F.size(F.array_except("projects", F.array("project"))) > 0, "project_leak") if has("project") and has("projects") else no,
            F.when(~F.col("cited"), "citation_invalid") if has("cited") else no,
            F.when(~F.col("flagged"), "trust_flag_missing") if has("flagged") else no,
            F.when(F.col("latency_ms") > F.col("most_ms"), "latency_exceeded") if has("latency_ms") and has("most_ms") else no,
        )
    )
    return joined.select("query_id", F.array_join(failures, ",").alias("failures"))


def checked_suite(suite: dict) -> dict:
    """A suite of canaries, if it has a version and 1 to 100 cases with different ids and a query each; else an error."""
    cases = suite.get("cases") if isinstance(suite, dict) else None
    if not isinstance(suite, dict) or not str(suite.get("version") or "").strip():
        raise ValueError("a suite must be an object with a version")
    if not isinstance(cases, list) or not 1 <= len(cases) <= 100:
        raise ValueError("a suite has between 1 and 100 cases")
    ids = [str(c.get("id") or "").strip() if isinstance(c, dict) else "" for c in cases]
    if not all(ids) or len(set(ids)) < len(ids):
        raise ValueError("cases have ids, each its own")
    if missing := [i for i, c in zip(ids, cases) if not str(c.get("query") or "").strip()]:
        raise ValueError(f"cases without a query: {missing}")
    return suite


def suite_hash(suite: dict) -> str:
    """SHA-256 of the suite as canonical JSON."""
    return hashlib.sha256(json.dumps(suite, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
