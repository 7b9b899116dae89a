"""Dialogue from session records: visible messages, documents, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators import blocks

# Gap and most messages of a segment.
GAP_SECONDS, MOST_MESSAGES = 1800, 12


def role_runs(chunks: DataFrame, order: list[str] | None = None, parts: list[str] | None = None) -> DataFrame:
    """Join consecutive chunks of one role: from (session, place, kind, text, ts) to (session, run, role, text, ts, place).

    kind is user, assistant, or end, which closes a message; rows of other kinds must be left out before. place is that
    of the message's first chunk. Chunks are ordered in blocks of a session, which are carried on (see blocks); order and
    parts name the columns of the order and of the blocks, where they aren't made of a number `place`.
    """
    order = order or ["place"]
    cut = chunks if parts else chunks.withColumn("_part", blocks.block(F.col("place")))
    numbered = blocks.runs(cut, ["session"], parts or ["_part"], order, "kind", lambda before, now: ~before.eqNullSafe(now))
    # The chunks of one message; a message is the unit of text here and stays whole.
    pieces = numbered.where("kind <> 'end'").groupBy("session", F.col("nth").alias("run"), F.col("kind").alias("role")).agg(
        F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("p"), F.max("ts").alias("ts"), F.min(order[0]).alias(order[0])
    )
    return pieces.select("session", "run", "role", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), "ts", order[0])


def canonical(messages: DataFrame) -> DataFrame:
    """Of each unit the messages of the first channel, or those of the second if it has none of the first."""
    least = messages.groupBy("unit").agg(F.min("channel").alias("channel"))
    return messages.join(least, ["unit", "channel"])


def iso(ts: Column) -> Column:
    """A time as ISO text in UTC, with as many decimals as Python gives: none or six."""
    us = F.unix_micros(ts)
    whole = F.date_format(F.to_utc_timestamp(F.timestamp_micros(us), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(us % 1_000_000 != 0, F.concat(F.lit("."), F.lpad((F.pmod(us, F.lit(1_000_000))).cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def render(messages: DataFrame) -> DataFrame:
    """One document for each session of (session, place, role, text, ts timestamp): headed blocks, newest time, number of messages.

    Messages without a time aren't part of it. A document is one text and made where all of it is.
    """
    block = F.concat(F.upper("role"), F.lit(" ["), iso(F.col("ts")), F.lit("]\n"), F.col("text"))
    parts = messages.where("ts is not null").groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("p"), F.max("ts").alias("ts"), F.count("*").alias("message_count")
    )
    return parts.select("session", F.array_join(F.transform("p", lambda x: x["block"]), "\n\n").alias("text"), "ts", "message_count")


def latest_of_key(documents: DataFrame, key: list[str], at: Column, place: Column) -> DataFrame:
    """Of each key the row of the latest time, ties to the later place."""
    order = Window.partitionBy(*key).orderBy(F.desc_nulls_last(at), F.desc(place))
    return documents.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def segments(messages: DataFrame, gap_seconds: int = GAP_SECONDS, most: int = MOST_MESSAGES) -> DataFrame:
    """Add `segment` to (session, ts, place): a new one after a gap longer than the limit, and after `most` messages."""
    order = Window.partitionBy("session").orderBy("ts", "place")
    pause = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) > gap_seconds * 1_000_000
    sat = messages.withColumn("_sitting", F.sum(F.coalesce(pause.cast("int"), F.lit(0))).over(order))
    own = Window.partitionBy("session", "_sitting").orderBy("ts", "place")
    unit = F.floor((F.row_number().over(own) - 1) / most)
    counted = sat.withColumn("_unit", unit)
    by_unit = Window.partitionBy("session").orderBy("_sitting", "_unit")
    return counted.withColumn("segment", F.dense_rank().over(by_unit) - 1).drop("_sitting", "_unit")
