"""Session files of agents, one JSON object on a line: messages, and one document of each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.redact import spoken
from loomstead.functions.text import is_blank, strip
from loomstead.functions.timestamps import stored_instant
from loomstead.operators import dialogue

#: Kinds of blocks whose text is shown.
SHOWN = ("text", "input_text", "output_text")


def read_lines(spark: SparkSession, paths: list[str], pattern: str = "*.jsonl") -> DataFrame:
    """(file, at, raw, record, malformed) of all lines that aren't blank, `at` in the order of the file.

    record is a VARIANT, null where the line is no JSON object. Folders are read with all below them. Raises if none
    of the paths exists: an unavailable source is no empty one.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in paths if (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(x)]
    if not there:
        raise FileNotFoundError(f"none of these exists: {paths}")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(there)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = lines.select(_decoded(F.col("_metadata.file_path")).alias("file"), at.alias("at"), F.col("value").alias("raw")).where(~is_blank(F.col("raw")))
    parsed = strict_json(F.col("raw"))
    lines = lines.withColumn("record", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
    return lines.withColumn("malformed", F.col("record").isNull())


def strict_json(raw: Column) -> Column:
    """A text as VARIANT if all of it is one JSON value, else null; the parser alone stops after the first value."""
    listed, named = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    one = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(one & named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def _decoded(path: Column) -> Column:
    """A path without percent signs; unlike in forms, a plus is itself."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def scan_summary(lines: DataFrame) -> DataFrame:
    """(file, scanned, malformed) of each file."""
    return lines.groupBy("file").agg(F.count("*").alias("scanned"), F.count_if("malformed").alias("malformed"))


def text_at(v: Column, path: str) -> Column:
    """What stands at a path as text; null for nothing, objects and lists."""
    inner = F.try_variant_get(v, path, "variant")
    return F.when(~F.schema_of_variant(inner).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, path, "string"))


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def visible_text(content: Column) -> Column:
    """The text of a content: of a string itself, of an object or of a list's objects that of shown kinds, and a list's strings."""
    said = F.try_variant_get(content, "$.text", "variant")
    kind = F.lower(F.coalesce(text_at(content, "$.type"), F.lit("text")))
    one = F.when(kind.isin(*SHOWN) & _is_text(said), F.try_variant_get(content, "$.text", "string"))

    def block(b: Column) -> Column:
        inner = F.try_variant_get(b, "$.text", "variant")
        shown = F.lower(F.coalesce(text_at(b, "$.type"), F.lit(""))).isin(*SHOWN) & _is_text(inner)
        return F.when(_is_text(b), F.try_variant_get(b, "$", "string")).when(shown, F.try_variant_get(b, "$.text", "string"))

    each = F.transform(F.try_variant_get(content, "$", "array<variant>"), block)
    shape = F.schema_of_variant(content)
    return F.coalesce(
        F.when(shape == "STRING", F.try_variant_get(content, "$", "string"))
        .when(shape.startswith("OBJECT"), one)
        .when(shape.startswith("ARRAY"), F.array_join(F.array_compact(each), "\n")),
        F.lit(""),
    )


def _dated(df: DataFrame, cutoff: str | None) -> DataFrame:
    """Messages with text and a time, from the cutoff on; a time that can't be read is none."""
    timed = df.withColumn("ts", F.timestamp_micros("us")).drop("us").where("text <> '' and ts is not null")
    return timed.where(F.col("ts") >= F.to_timestamp(F.lit(cutoff))) if cutoff else timed


def _first(*paths: str) -> Column:
    given = [F.nullif(text_at(F.col("record"), p), F.lit("")) for p in paths]
    return stored_instant(F.coalesce(*given))


def agent_messages(lines: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Messages of records with a message field: (file, at, role, text, ts); side chains and meta records are none."""
    r = F.col("record")
    kind = F.lower(text_at(r, "$.type"))
    role = F.lower(F.coalesce(text_at(r, "$.message.role"), kind))
    aside = [F.coalesce(~F.lower(text_at(r, p)).isin("false", "0", ""), F.lit(False)) for p in ("$.isSidechain", "$.is_sidechain", "$.isMeta")]
    shown = kind.isin("user", "assistant") & role.isin("user", "assistant") & ~aside[0] & ~aside[1] & ~aside[2]
    said = spoken(visible_text(F.try_variant_get(r, "$.message.content", "variant")))
    return _dated(lines.where(shown).select("file", "at", role.alias("role"), said.alias("text"), _first("$.timestamp", "$.message.timestamp").alias("us")), cutoff)


def channel_messages(lines: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Messages of response items, or, where a file has none of these with text, of mirrored events: (file, at, role, text, ts)."""
    r = F.col("record")
    kind, sort, role = (F.lower(text_at(r, p)) for p in ("$.type", "$.payload.type", "$.payload.role"))
    direct = (kind == "response_item") & (sort == "message") & role.isin("user", "assistant")
    mirrored = (kind == "event_msg") & sort.isin("user_message", "agent_message")
    plain = F.coalesce(F.nullif(text_at(r, "$.payload.message"), F.lit("")), text_at(r, "$.payload.text"), F.lit(""))
    made = lines.where(direct | mirrored).select(
        F.col("file").alias("unit"), "at", F.when(direct, 0).otherwise(1).alias("channel"),
        F.when(direct, role).when(sort == "user_message", "user").otherwise("assistant").alias("role"),
        spoken(F.when(direct, visible_text(F.try_variant_get(r, "$.payload.content", "variant"))).otherwise(plain)).alias("text"),
        _first("$.timestamp", "$.payload.timestamp").alias("us"),
    )
    return dialogue.canonical(_dated(made, cutoff)).drop("channel").withColumnRenamed("unit", "file")


def streamed_messages(lines: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Chunks joined to messages: (file, at, role, text, ts); a chunk without a time doesn't make its message newer."""
    r = F.col("record")
    sort = F.lower(text_at(r, "$.params.update.sessionUpdate"))
    kind = F.when(sort == "user_message_chunk", "user").when(sort == "agent_message_chunk", "assistant").when(sort == "turn_completed", "end")
    chunks = lines.where(kind.isNotNull()).select(
        F.col("file").alias("session"), "at", F.col("at.block").alias("part"), kind.alias("kind"),
        visible_text(F.try_variant_get(r, "$.params.update.content", "variant")).alias("text"), _first("$.timestamp").alias("ts"),
    )
    whole = dialogue.role_runs(chunks, ["at"], ["part"])
    made = whole.select(F.col("session").alias("file"), "at", "role", spoken(F.col("text")).alias("text"), F.col("ts").alias("us"))
    return _dated(made, cutoff)


def exported_messages(lines: DataFrame, cutoff: str | None = None) -> DataFrame:
    """Messages of exported sessions, one session on a line: (file, session, at, place, role, text, ts)."""
    r = F.col("record")
    each = lines.select("file", text_at(r, "$.id").alias("session"), "at", F.posexplode(F.try_variant_get(r, "$.messages", "array<variant>")).alias("place", "m"))
    m = F.col("m")
    made = each.where("session is not null").select(
        "file", "session", "at", "place", F.lower(text_at(m, "$.role")).alias("role"), spoken(visible_text(F.try_variant_get(m, "$.content", "variant"))).alias("text"),
        stored_instant(text_at(m, "$.timestamp")).alias("us"),
    )
    return _dated(made.where("role in ('user', 'assistant')"), cutoff)


#: Messages of each source, and where its records name the session and the folder it ran in.
SOURCES = {
    "claude": (agent_messages, "$.sessionId", "$.cwd"),
    "codex": (channel_messages, "$.payload.id", "$.payload.cwd"),
    "grok": (streamed_messages, "$.params.sessionId", None),
}


def scan(lines: DataFrame, source: str, cutoff: str | None = None) -> DataFrame:
    """(source_key, file, project, text, ts, message_count, status) of the sessions in the files of a source.

    A file without a message since the cutoff is kept, without text: it is still there, so its key counts as seen. Of
    files with one key the newest document stays, ties to the later file.
    """
    messages, session_at, cwd_at = SOURCES[source]
    said = dialogue.render(messages(lines, cutoff).select(F.col("file").alias("session"), F.col("at").alias("place"), "role", "text", "ts"))
    r = F.col("record")
    own = (F.lower(text_at(r, "$.type")) == "session_meta") if source == "codex" else F.lit(True)
    named = lambda p: F.min_by(text_at(r, p), F.when(own & (F.coalesce(text_at(r, p), F.lit("")) != ""), F.col("at")))
    parts = F.split("file", "/")
    stem, parent, above = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""), F.element_at(parts, -2), F.element_at(parts, -3)
    files = lines.groupBy("file").agg(named(session_at).alias("id"), (named(cwd_at) if cwd_at else F.lit(None).cast("string")).alias("cwd"))
    cwd = _decoded(above) if source == "grok" else F.col("cwd")
    project = F.nullif(F.regexp_extract(strip(cwd), r"([^/\\]+)[/\\]*$", 1), F.lit(""))
    project = F.coalesce(project, parent) if source == "claude" else project
    key = F.concat(F.lit("session:"), F.coalesce("id", parent if source == "grok" else stem))
    made = files.select("file", key.alias("source_key"), project.alias("project")).join(said.withColumnRenamed("session", "file"), "file", "left")
    status = F.when(F.col("text").isNull(), "kept").otherwise("read")
    made = made.select("source_key", "file", "project", "text", "ts", F.coalesce("message_count", F.lit(0)).alias("message_count"), status.alias("status"))
    newest = made.groupBy("source_key").agg(F.max(F.struct("ts", "file")).alias("best"))
    return made.join(newest.select("source_key", F.col("best.file").alias("file")), ["source_key", "file"])


def watermark(documents: DataFrame, cutoff: str) -> DataFrame:
    """One row: the newest time of the documents, else the cutoff."""
    return documents.agg(F.coalesce(F.max("ts"), F.to_timestamp(F.lit(cutoff))).alias("watermark"))
