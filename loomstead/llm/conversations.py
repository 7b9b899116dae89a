"""Rebuilding conversations from single message rows.

Each source's rows become events in one form: a unit (session or file), a place in it, a kind (user, assistant, or
the end of a message), and whether its text is blank. Texts and ids are left behind, so that only narrow rows move.
Units are tied into conversations as connected components over their links. All that needs the order of rows is
computed within blocks of places and carried from block to block, so that a conversation of any length is shared
between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions.text import is_blank, word
from loomstead.llm.components import components
from loomstead.operators import blocks
from loomstead.session import table, write_once

_UNIT = ["source", "unit", "channel"]


def speaker(role: Column) -> Column:
    """user or assistant, by any of their names; else null."""
    r = word(role)
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "ai", "model"), "assistant")


def _event(source: str, unit: Column, place: Column, kind: Column, blank: Column, null: Column, channel: Column | None = None, *content: Column):
    mark = F.struct(F.xxhash64(*content), F.xxhash64(F.lit(1), *content), F.hash(*content))
    return [
        F.lit(source).alias("source"),
        unit.alias("unit"),
        place.cast("long").alias("place"),
        "row_id",
        mark.alias("mark"),
        (channel if channel is not None else F.lit(0)).alias("channel"),
        kind.alias("kind"),
        (~blank).alias("text"),
        null.alias("null"),
    ]


def _spoken(blocks: Column) -> Column:
    """Whether any text block of a content array has non-blank text."""
    return F.coalesce(
        F.exists(
            blocks,
            lambda b: F.coalesce(word(b["type"]).isin("text", "input_text", "output_text"), F.lit(False)) & ~is_blank(b["text"]),
        ),
        F.lit(False),
    )


def grok_text(content: Column) -> Column:
    """The text of a chunk: plain, or the text of a JSON object of type text."""
    parsed = F.from_json(content, "type string, text string")
    # The parser stops after an object; with more text behind it the content is plain.
    is_object = F.ltrim(content).startswith("{") & F.rtrim(content).endswith("}") & parsed["type"].isNotNull()
    return F.when(is_object, F.coalesce(parsed["text"], F.lit(""))).otherwise(content)


def hermes_events(df: DataFrame) -> DataFrame:
    role = speaker(F.col("role"))
    blank = is_blank(F.col("content"))
    return df.select(
        *_event(
            "hermes", F.col("session_id"), F.col("seq"), F.when(~blank, role), blank, F.col("role").isNull(), None,
            F.col("role"), F.col("content"), F.col("timestamp"),
        )
    )


def codex_events(df: DataFrame) -> DataFrame:
    p = F.col("payload")
    kind, sort = word(F.col("type")), word(p["type"])
    said = F.when((kind == "response_item") & (sort == "message") & _spoken(p["content"]), speaker(p["role"]))
    mirrored = F.when(
        (kind == "event_msg") & ~is_blank(p["message"]),
        F.when(sort == "user_message", "user").when(sort == "agent_message", "assistant"),
    )
    channel = F.when(said.isNotNull(), 0).when(mirrored.isNotNull(), 1).otherwise(0)
    return df.select(
        *_event(
            "codex", F.col("file"), F.col("line_no"), F.coalesce(said, mirrored), F.lit(False), p.isNull(), channel,
            F.col("type"), F.col("timestamp"), F.to_json(p),
        )
    )


def grok_events(df: DataFrame) -> DataFrame:
    update = F.col("params.update")
    sort = word(update["sessionUpdate"])
    kind = F.when(sort == "user_message_chunk", "user").when(sort == "agent_message_chunk", "assistant").when(sort == "turn_completed", "end")
    return df.select(
        *_event(
            "grok", F.col("params.sessionId"), F.col("line_no"), kind, is_blank(grok_text(update["content"])), update.isNull(), None,
            F.col("cwd"), F.col("timestamp"), F.col("method"), F.to_json("params"),
        )
    )


def file_sessions(codex: DataFrame) -> DataFrame:
    """The session of each file: (unit, session), by the links of files to the ids their metadata names."""
    meta = codex.where((word(F.col("type")) == "session_meta") & F.col("payload.id").isNotNull())
    links = meta.select(F.concat(F.lit("f:"), "file").alias("u"), F.concat(F.lit("a:"), "payload.id").alias("v"))
    # Ids sort before files, so that a component is named by its (least) id.
    tied = components(links).where("node like 'f:%'")
    return tied.select(F.substring("node", 3, 1 << 30).alias("unit"), F.substring("component", 3, 1 << 30).alias("session"))


def file_stem(file: Column) -> Column:
    """A file's name without directory and .jsonl."""
    return F.regexp_replace(F.regexp_replace(file, r"^.*[/\\]", ""), r"\.jsonl$", "")


def link_sessions(messages: DataFrame) -> DataFrame:
    """Conversations of messages without identifiers: (message_id, conversation).

    messages: message_id, reply_to (a message_id or null), content. Links are replies, and quotes: a paragraph of
    lines that begin with > is tied to the message whose whole text it repeats, else one of whose paragraphs, else one
    of whose lines; else one of its lines is looked for alike. Lines that quote are no text of their message. A message
    without links is a conversation of its own; a reply to an unknown message counts as no link.
    """
    ids = messages.select("message_id").where("message_id is not null").distinct()
    replies = messages.select(F.col("message_id").alias("u"), F.col("reply_to").alias("v")).join(
        ids.select(F.col("message_id").alias("v")), "v", "left_semi"
    )
    quote = F.explode(F.regexp_extract_all("content", F.lit(r"(?m)((?:^>.*\n?)+)"), F.lit(1)))
    unquoted = F.trim(F.regexp_replace("quote", r"(?m)^> ?", ""))
    quotes = messages.select(F.col("message_id").alias("u"), quote.alias("quote")).select("u", F.btrim(unquoted, F.lit("\n ")).alias("quote"))
    asked = F.concat(F.array(F.struct(F.lit(0).alias("form"), F.col("quote").alias("said"))), F.transform(F.split("quote", "\n"), lambda x: F.struct(F.lit(1).alias("form"), F.btrim(x).alias("said"))))
    quotes = quotes.withColumn("part", F.explode(asked)).select("u", "quote", "part.form", "part.said").where("said <> ''")
    own = messages.where("message_id is not null").withColumn("own", F.regexp_replace("content", r"(?m)^>.*$", ""))
    # Whole texts, paragraphs and lines.
    part = lambda depth, texts: F.transform(texts, lambda x: F.struct(F.lit(depth).alias("depth"), F.btrim(x, F.lit("\n ")).alias("said")))
    parts = F.concat(part(0, F.array("content")), part(1, F.split("own", r"\n[ \t]*\n")), part(2, F.split("own", "\n")))
    held = own.select(F.col("message_id").alias("v"), F.explode(parts).alias("part")).select("v", "part.depth", "part.said").where("said <> ''")
    held = held.groupBy("said", "v").agg(F.min("depth").alias("depth"))
    # Of messages with the same text the first is meant; the second serves where that is the quoting one.
    order = Window.partitionBy("said").orderBy("depth", "v")
    first = held.withColumn("n", F.row_number().over(order)).where("n <= 2")
    quoted = quotes.join(first, "said").where("u <> v").groupBy("u", "quote").agg(F.min(F.struct("form", "depth", "v")).alias("at")).select("u", F.col("at.v").alias("v"))
    tied = components(replies.select("u", "v").unionByName(quoted))
    return ids.join(tied.withColumnRenamed("node", "message_id"), "message_id", "left").select(
        "message_id", F.coalesce("component", "message_id").alias("conversation")
    )


def rebuild(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Kept conversations: (source, session_id, row_id, turn), one row for each message row.

    events: as made by the *_events functions; sessions: (source, unit, session) of units that belong to another
    session than their own. Repeats at one place count once. Left out are conversations in which different rows
    share a place, a place is missing or null, a row is unreadable, or the messages aren't the user's first, the
    assistant's last and each user message followed by the assistant. Units without a name are left out.
    """
    events = events.where("unit is not null").withColumn("block", blocks.block(F.col("place")))
    # One shuffle by unit and block serves the removal of repeats; equal rows have equal marks and flags.
    places = events.groupBy("source", "unit", "block", "place").agg(
        F.min("row_id").alias("row_id"),
        F.min("channel").alias("channel"),
        F.max("kind").alias("kind"),
        F.max("text").alias("text"),
        F.max((F.col("null") | F.col("place").isNull()).cast("int")).alias("bad"),
        F.min("mark.col1").alias("m1"), F.max("mark.col1").alias("n1"),
        F.min("mark.col2").alias("m2"), F.max("mark.col2").alias("n2"),
        F.min("mark.col3").alias("m3"), F.max("mark.col3").alias("n3"),
    )
    conflict = (F.col("m1") != F.col("n1")) | (F.col("m2") != F.col("n2")) | (F.col("m3") != F.col("n3"))
    places = write_once(
        places.select("source", "unit", "block", "place", "row_id", "channel", "kind", "text", F.greatest("bad", conflict.cast("int")).alias("bad")),
        "places",
    )
    whole = places.groupBy("source", "unit").agg(
        F.max("bad").alias("bad"),
        (F.max("place") - F.min("place") + 1 - F.count("*")).alias("gaps"),
        F.max(F.when(F.col("kind").isin("user", "assistant") & (F.col("channel") == 0), 1).otherwise(0)).alias("first"),
    )
    named = whole.join(sessions, ["source", "unit"], "left").withColumn("session", F.coalesce("session", "unit"))
    by_session = Window.partitionBy("source", "session")
    judged = named.select(
        "source", "unit", "session",
        F.max(F.greatest("bad", (F.col("gaps") != 0).cast("int"))).over(by_session).alias("bad"),
        F.max("first").over(by_session).alias("direct"),
    )
    good = judged.where("bad = 0").select("source", "unit", "session", F.when(F.col("direct") == 1, 0).otherwise(1).alias("channel"))
    rows = places.where("kind is not null").drop("bad").join(good, ["source", "unit", "channel"])
    rows = rows.select("source", "session", F.col("unit").alias("file"), "block", "place", "row_id", "kind", "text")
    session, order = ["source", "session"], ["file", "place"]
    # Chunks of a stream go on the message of the chunk before if that is of the same kind.
    rows = rows.withColumn("said", F.concat_ws("/", F.when(F.col("source") == "grok", "part"), "kind"))
    goes_on = lambda before, now: before.eqNullSafe(now) & now.startswith("part/")
    rows = blocks.runs(rows, session, ["file", "block"], order, "said", lambda before, now: ~goes_on(before, now))
    rows = write_once(rows.where("kind <> 'end'").select(*session, "file", "block", "place", "row_id", "kind", "text", "nth"), "rows")
    messages = rows.groupBy(*session, "nth").agg(
        F.min(F.struct("file", "place", "block")).alias("at"), F.max("kind").alias("kind"), F.max("text").alias("text")
    )
    messages = messages.where("text").select(*session, F.col("nth").alias("message"), "at.file", "at.place", "at.block", "kind")
    messages = blocks.runs(messages, session, ["file", "block"], order, "kind", lambda *_: F.lit(True))
    messages = write_once(messages.select(*session, F.col("message").alias("nth"), F.col("nth").alias("turn"), "kind", "prev"), "messages")
    # The user's first, the assistant's last, and no two user messages in a row.
    fine = messages.groupBy(*session).agg(
        F.max(
            (F.col("prev").isNull() & (F.col("kind") == "assistant")) | (F.col("kind").eqNullSafe("user") & F.col("prev").eqNullSafe("user"))
        ).alias("wrong"),
        F.max_by("kind", "turn").alias("last"),
    )
    fine = fine.where("not wrong and last = 'assistant'").select(*session)
    kept = messages.select(*session, "nth", "turn").join(fine, session, "left_semi")
    return rows.join(kept, [*session, "nth"]).select("source", F.col("session").alias("session_id"), "row_id", F.col("turn").cast("int").alias("turn"))


def linked_conversations(messages: DataFrame) -> DataFrame:
    """Kept conversations of messages without identifiers: (session_id, row_id, turn), as rebuild() keeps them.

    messages: message_id, reply_to, row_id, role, content, at (a time). They are tied by link_sessions() and ordered by
    time, then message_id; messages without a time come first. Rows of one message_id are one message, the smallest row.
    """
    once = messages.where("message_id is not null").groupBy("message_id").agg(F.min_by(F.struct("reply_to", "row_id", "role", "content", "at"), "row_id").alias("m"))
    once = once.select("message_id", "m.*")
    tied = once.join(link_sessions(once), "message_id")
    order = Window.partitionBy("conversation").orderBy(F.asc_nulls_first("at"), "message_id")
    placed = tied.withColumn("place", F.row_number().over(order))
    role, blank = speaker(F.col("role")), is_blank(F.col("content"))
    events = placed.select(
        *_event("linked", F.col("conversation"), F.col("place"), F.when(~blank, role), blank, F.col("role").isNull(), None, F.col("role"), F.col("content"))
    )
    none = messages.sparkSession.createDataFrame([], "source string, unit string, session string")
    return rebuild(events, none).drop("source")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept conversations of the three message tables."""
    codex = table(spark, sf_dir, "codex_records")
    events = (
        hermes_events(table(spark, sf_dir, "hermes_messages"))
        .unionByName(codex_events(codex))
        .unionByName(grok_events(table(spark, sf_dir, "grok_records")))
    )
    files = codex.select(F.col("file").alias("unit")).where("unit is not null").distinct()
    tied = files.join(file_sessions(codex), "unit", "left")
    sessions = tied.select(F.lit("codex").alias("source"), "unit", F.coalesce("session", file_stem(F.col("unit"))).alias("session"))
    return rebuild(events, sessions)


def with_texts(turns: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered messages: (source, session_id, turn, role, text), chunks of a message joined."""
    hermes = table(spark, sf_dir, "hermes_messages").select(
        F.lit("hermes").alias("source"), "row_id", F.lit(0).alias("at"), speaker(F.col("role")).alias("role"), F.col("content").alias("text")
    )
    p = F.col("payload")
    blocks = F.filter(p["content"], lambda b: word(b["type"]).isin("text", "input_text", "output_text"))
    spoken = F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")
    role = F.coalesce(speaker(p["role"]), F.when(word(p["type"]) == "user_message", "user").otherwise("assistant"))
    codex = table(spark, sf_dir, "codex_records").select(
        F.lit("codex").alias("source"), "row_id", F.lit(0).alias("at"), role.alias("role"),
        F.when(word(p["type"]) == "message", spoken).otherwise(p["message"]).alias("text"),
    )
    update = F.col("params.update")
    grok = table(spark, sf_dir, "grok_records").select(
        F.lit("grok").alias("source"), "row_id", F.col("line_no").alias("at"),
        F.when(word(update["sessionUpdate"]) == "user_message_chunk", "user").otherwise("assistant").alias("role"),
        grok_text(update["content"]).alias("text"),
    )
    said = turns.join(hermes.unionByName(codex).unionByName(grok), ["source", "row_id"])
    # The chunks of one message; a message is the unit of text here and stays whole.
    joined = said.groupBy("source", "session_id", "turn", "role").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return joined.select("source", "session_id", "turn", "role", F.array_join(F.transform("parts", lambda x: x["text"]), "").alias("text"))
