"""The document store as snapshots: classify, merge, reconcile, manifests, receipts, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import stable_id

# A source's documents are only deleted in bulk if it has few, or at least this part of them was seen.
FLOOR_FROM, FLOOR_RATIO = 10, 0.5
KEY = ["source", "source_key"]


def classify(incoming: DataFrame, stored: DataFrame, current: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Add `status` to incoming (keys, content_hash): created, updated or unchanged.

    current: the keys of documents that have chunks, all of them of the present models; where given, others are updated
    even if their hash is the same. force: nothing counts as unchanged.
    """
    known = stored.select(*KEY, F.col("content_hash").alias("_known"))
    both = incoming.join(known, KEY, "left")
    stays = (F.col("_known") == F.col("content_hash")) & F.lit(not force)
    if current is not None:
        both = both.join(current.select(*KEY, F.lit(True).alias("_current")).distinct(), KEY, "left")
        stays = stays & F.coalesce("_current", F.lit(False))
    status = F.when(F.col("_known").isNull(), "created").when(F.coalesce(stays, F.lit(False)), "unchanged").otherwise("updated")
    return both.withColumn("status", status).drop("_known", "_current")


def current_documents(stored: DataFrame, chunks: DataFrame, model: str, dims: int) -> DataFrame:
    """Keys of stored documents with at least one chunk and no chunk of another model or length."""
    fits = (F.col("embedding_model") == model) & (F.col("embedding_dimensions") == dims)
    whole = chunks.groupBy("document_id").agg(F.min(F.coalesce(fits, F.lit(False)).cast("int")).alias("fits")).where("fits = 1")
    return stored.join(whole.select("document_id"), "document_id", "left_semi").select(*KEY)


def replaced_chunks(old: DataFrame, new: DataFrame, updated: DataFrame) -> DataFrame:
    """Chunks (document_id, ordinal) after the updated documents (document_id) got their new ones; ids depend on these two only."""
    kept = old.select("document_id", "ordinal").distinct().join(updated, "document_id", "left_anti").withColumn("is_new", F.lit(False))
    made = new.select("document_id", "ordinal").join(updated, "document_id", "left_semi").withColumn("is_new", F.lit(True))
    return kept.unionByName(made).withColumn("chunk_id", stable_id("chk", F.col("document_id"), F.col("ordinal").cast("string")))


def merge(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The next snapshot: incoming rows over stored ones; a document keeps its first id and creation."""
    new = incoming.select(*KEY, F.col("content_hash").alias("_hash"), F.col("ts").alias("_ts"))
    both = stored.select(*KEY, "document_id", "content_hash", "ts").join(new, KEY, "full")
    return both.select(
        *KEY,
        F.coalesce("document_id", stable_id("doc", F.col("source"), F.col("source_key"))).alias("document_id"),
        F.coalesce("_hash", "content_hash").alias("content_hash"),
        F.when(F.col("_hash").isNotNull(), F.col("_ts")).otherwise(F.col("ts")).alias("ts"),
    )


def floors(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Of each source: documents held, keys seen, and whether what wasn't seen may be deleted."""
    held = stored.groupBy("source").agg(F.count("*").alias("held"))
    found = seen.select(*KEY).distinct().groupBy("source").agg(F.count("*").alias("seen"))
    joined = held.join(found, "source", "left").select("source", "held", F.coalesce("seen", F.lit(0)).alias("seen"))
    refused = (F.col("held") >= FLOOR_FROM) & (F.col("seen") < F.col("held") * FLOOR_RATIO)
    return joined.withColumn("allowed", ~refused)


def unseen(stored: DataFrame, seen: DataFrame, kept_kinds: tuple[str, ...] = ("memory",)) -> DataFrame:
    """Stored documents whose key wasn't seen, of sources that pass the floor; some kinds always stay."""
    allowed = floors(stored, seen).where("allowed").select("source")
    gone = stored.where(~F.col("source").isin(*kept_kinds)).join(seen.select(*KEY), KEY, "left_anti")
    return gone.join(F.broadcast(allowed), "source", "left_semi")


def manifests(gone: DataFrame, chunks: DataFrame, reason: str) -> DataFrame:
    """One row for each deleted document: counts, hashed key, canonical JSON and its hash."""
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    rows = gone.join(counted, "document_id", "left").select(
        "document_id", "source", F.sha2("source_key", 256).alias("source_key_hash"), "content_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )
    # Keys in order, as canonical JSON has them.
    body = F.to_json(F.struct("chunk_count", "content_hash", "document_id", F.lit(reason).alias("reason"), "source", "source_key_hash"))
    return rows.withColumn("manifest_hash", F.sha2(body, 256))


def receipts(versions: DataFrame, artifact: Column, order: list[str], at: str) -> DataFrame:
    """Receipts of all versions of artifacts, superseded ones with the time of what followed.

    A version that comes back reactivates its old receipt: one row for each receipt, with its first time and, unless
    it is the artifact's last, the time it was last superseded.
    """
    ids = versions.withColumn("artifact", artifact).withColumn("receipt_id", stable_id("rcpt", F.col("artifact"), F.col("content_hash")))
    own = Window.partitionBy("artifact").orderBy(*order)
    steps = ids.withColumn("_next", F.lead("receipt_id").over(own)).withColumn("_until", F.lead(at).over(own))
    ended = F.when(F.col("_next").isNotNull() & (F.col("_next") != F.col("receipt_id")), F.col("_until"))
    steps = steps.withColumn("_ended", ended).withColumn("_last", F.col("_next").isNull())
    return steps.groupBy("artifact", "receipt_id").agg(
        F.min(at).alias("created_at"), F.when(~F.bool_or("_last"), F.max("_ended")).alias("superseded_at")
    )


def source_states(runs: DataFrame) -> DataFrame:
    """State of each source after all its runs: last times, watermark, failures since the last success, status."""
    good = F.col("successful") & F.col("watermark").isNotNull()
    last = runs.groupBy("source").agg(
        F.max("started_at").alias("last_started"),
        F.max(F.when(good, F.col("started_at"))).alias("last_success"),
        F.max_by(F.when(good, F.col("watermark")), F.when(good, F.col("started_at"))).alias("watermark"),
        F.max(F.when(~F.col("successful"), F.col("started_at"))).alias("last_failure"),
        F.sum("scanned").alias("scanned"),
    )
    since = runs.join(last.select("source", "last_success"), "source").where(
        ~F.col("successful") & (F.col("last_success").isNull() | (F.col("started_at") > F.col("last_success")))
    )
    failures = since.groupBy("source").agg(F.count("*").alias("failures"))
    status = F.when(F.coalesce("failures", F.lit(0)) > 0, "failed").when(F.col("last_success").isNull(), "never").otherwise("ok")
    return last.join(failures, "source", "left").select("*", status.alias("status")).withColumn("failures", F.coalesce("failures", F.lit(0)))


def refreshed(incoming: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Unchanged documents with the columns of their latest delivery: only these are written, no chunk and no vector."""
    return classify(incoming, stored).where("status = 'unchanged'").select(*KEY, *columns)


def generation(number: int, changed: DataFrame, gone: DataFrame) -> DataFrame:
    """One row (changed, deleted, generation, index): any changed or deleted document makes a next generation, of which the index is stale."""
    one = changed.agg(F.count("*").alias("changed")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("deleted"))))
    moved = F.col("changed") + F.col("deleted") > 0
    return one.select("changed", "deleted", (F.lit(number) + moved.cast("int")).alias("generation"), F.when(moved, "stale").otherwise("ready").alias("index"))


def index_backends(vectors: DataFrame, benchmark_ms: Column, backend: str, least: int, slow_ms: float) -> DataFrame:
    """(embedding_model, chunks, eligible, backend): an approximate index is for many vectors or a slow exact search, unless exact is asked for."""
    counted = vectors.groupBy("embedding_model").agg(F.count("*").alias("chunks"))
    eligible = ((F.col("chunks") >= least) | (benchmark_ms >= slow_ms)) & F.lit(backend != "exact")
    return counted.select("embedding_model", "chunks", eligible.alias("eligible"), F.when(eligible, "ann").otherwise("exact").alias("backend"))


def embedding_plan(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """What is done for each text to embed: (input_hash, model, dims, first, uses, origin).

    wanted: (chunk_pk, input_hash, model, dims); cache: (input_hash, model, dims) of vectors there are. A text is taken
    from the cache, else embedded once, for its first chunk; a vector of another model or length doesn't serve.
    """
    key = ["input_hash", "model", "dims"]
    texts = wanted.groupBy(*key).agg(F.min("chunk_pk").alias("first"), F.count("*").alias("uses"))
    held = cache.select(*key, F.lit("cache").alias("origin")).distinct()
    return texts.join(held, key, "left").withColumn("origin", F.coalesce("origin", F.lit("embed")))


def missing_receipts(artifacts: DataFrame, receipts: DataFrame) -> DataFrame:
    """Artifacts (artifact_type, artifact_id) without an active receipt, with the id that theirs gets."""
    active = receipts.where("superseded_at is null").select("artifact_type", "artifact_id")
    gone = artifacts.join(active, ["artifact_type", "artifact_id"], "left_anti")
    fields = [F.col(c) for c in ("artifact_type", "artifact_id", "content_hash", "producer", "producer_version")]
    return gone.withColumn("receipt_id", stable_id("rcpt", *fields))


def attempt_states(attempts: DataFrame, unit: list[str], at: list[str]) -> DataFrame:
    """The state of each unit after its attempts: (unit, state, attempts, last_at, last_success, last_error).

    attempts: the unit, the columns `at` in whose order they happened (the first is their time), outcome (null while it
    runs), blocked, error. A blocked unit is policy_blocked; else its last attempt decides: pending, ready or failed. The
    last success and the last error stay known through later attempts.
    """
    order = F.struct(*at)
    got = attempts.groupBy(*unit).agg(
        F.count("*").alias("attempts"), F.max(at[0]).alias("last_at"), F.max(F.when(F.col("outcome"), F.col(at[0]))).alias("last_success"),
        F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("last_error"), F.bool_or("blocked").alias("blocked"),
        F.max_by(F.coalesce(F.when(F.col("outcome"), "ready").when(~F.col("outcome"), "failed"), F.lit("pending")), order).alias("last"),
    )
    return got.select(*unit, F.when(F.col("blocked"), "policy_blocked").otherwise(F.col("last")).alias("state"), "attempts", "last_at", "last_success", "last_error")


def rollup(states: DataFrame, group: list[str]) -> DataFrame:
    """Of each group its units by state, and its status: ready if all are, partial if some are, else failed."""
    n = lambda state: F.count_if(F.col("state") == state).alias(state)
    got = states.groupBy(*group).agg(F.count("*").alias("units"), n("ready"), n("failed"), n("pending"), n("policy_blocked"))
    status = F.when(F.col("ready") == F.col("units"), "ready").when(F.col("ready") > 0, "partial").otherwise("failed")
    return got.withColumn("status", status)
