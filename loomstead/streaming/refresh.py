"""Continuous refresh: files arrive, new and changed documents are handed on, each under one number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstead.operators.incremental import KeyHashState, latest_versions


def refresh(
    stream: DataFrame, state: KeyHashState, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Each micro-batch of deliveries (source, source_key, row_id, text, timestamp) through the persisted state.

    The sink gets the documents that are new or changed, and the number of the state's run. After a crash between sink
    and state it gets the same rows under the same number again; one that keeps a number once (append_once) has every
    document once.
    """

    def handle(batch: DataFrame, _: int) -> None:
        newest = latest_versions(batch).where(~F.col("blank"))
        state.run(newest, sink)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def sittings(stream: DataFrame, gap: str = "30 minutes", late: str = "90 days") -> DataFrame:
    """Messages of each session between pauses: (session, from, to, messages); rows later than the watermark are left out."""
    counted = stream.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("messages"))
    return counted.select("session", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "messages")


def files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)
