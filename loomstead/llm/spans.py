"""Long exact spans shared between documents.

A span of `need` characters that two documents share holds, in both, the same window of k-grams; the least k-gram
hash of that window (its anchor) therefore is the same in both. So documents are cut, without looking at one
another, into stretches of windows with one anchor, and only stretches whose anchor stands in several documents can
hold a shared span. Those stretches ("contexts") are put together by anchor: each shard of them gets a compressed
full-text index, in which the matching statistics of all its contexts are found by backward search; spans long
enough are carried back to the documents and merged. No pair of documents is ever listed: equal contexts of any
number of documents are one row with the least and the greatest document, told apart by 128 bits of their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.fmindex import SharedTextIndex
from loomstead.llm.tokens import _sliced
from loomstead.session import spread, write_once

#: Characters of a k-gram; the window then has need - GRAM + 1 of them.
GRAM = 100
#: Characters in an index; one index never holds more than this and one anchor's contexts.
SHARD_CHARS = 300_000
#: Anchors with more different contexts than this don't fit into one index: their contexts are compared window by window.
HOT_CONTEXTS = 4_000
#: Keys of such anchors up to these bytes are sent to all executors, more are joined.
HOT_BYTES = 4 << 20


def _mix(a: np.ndarray, b: np.ndarray, odd: int) -> np.ndarray:
    out = a * np.uint64(odd)
    out += b
    out ^= out >> np.uint64(31)
    return out


def gram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` code points, built of those of its halves."""
    hashed = _mix(points.astype(np.uint64), np.uint64(1), 0x9E3779B97F4A7C15)
    out, done, width = None, 0, 1
    while True:
        if size & width:
            out = hashed if out is None else _mix(out[: len(points) - done - width + 1], hashed[done : len(points) - width + 1], 0xD6E8FEB86659FD93)
            done += width
            if done == size:
                return out[: len(points) - size + 1]
        hashed = _mix(hashed[: len(hashed) - width], hashed[width:], 0xA24BAED4963EE407)
        width *= 2


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, by minima from both ends of blocks as wide as the window."""
    n = len(values)
    blocks = np.full((-(-n // width), width), np.iinfo(values.dtype).max, values.dtype)
    blocks.ravel()[:n] = values
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])


def stretches(texts: list[str], need: int, gram: int) -> tuple[np.ndarray, ...]:
    """Windows of all texts by their anchor: owner (number of the text), hash, first and last window start in the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    none = np.zeros(0, np.int64)
    if len(points) < need:
        return none, none, none, none
    ends = np.cumsum(sizes)
    hashes = gram_hashes(points, gram)
    width = need - gram + 1
    place_bits = max(1, int(len(hashes)).bit_length())
    # Hash first, place second: of equal hashes the leftmost counts.
    keyed = hashes >> np.uint64(place_bits) << np.uint64(place_bits) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (least_in_window(keyed, width) & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    # A window counts if it lies within one text.
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - need + 1, 0))
    starts = np.arange(len(owner)) - (np.cumsum(np.maximum(sizes - need + 1, 0)) - np.maximum(sizes - need + 1, 0))[owner]
    anchor = anchor[starts + (ends - sizes)[owner]]
    if not len(anchor):
        return none, none, none, none
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]]) - 1
    return owner[first], hashes[anchor[first]].view(np.int64), starts[first], starts[last]


def _anchors(documents: DataFrame, need: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch, "text", 256 << 10):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                owner, h, first, last = stretches(part.column("text").to_pylist(), need, gram)
                columns = [pa.array(h), pa.array(ids[owner]), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "first", "last"])

    long_enough = documents.where((F.length("text") >= need) & F.col("doc_id").isNotNull())
    return spread(long_enough).mapInArrow(run, "h long, doc_id long, first int, last int")


def shared_spans(documents: DataFrame, need: int = 200, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Maximal stretches of each document that lie in spans shared with another: rows (doc_id, begin, end), disjoint.

    A span is a run of at least `need` code points that stands verbatim in a document of another doc_id. Null,
    empty and shorter texts have none; rows without a doc_id are left out; the same text twice under one doc_id
    is no other document. Other columns don't matter.
    """
    if not 1 <= gram <= need:
        raise ValueError("a k-gram must fit into the span")
    texts = documents.select("doc_id", "text")
    # Hashing reads all texts, and two steps need the anchors: they are written down once, at some 12 bytes each.
    anchors = write_once(_anchors(texts, need, gram), "anchors")
    # Partial aggregation leaves one row of each anchor and task, however many documents hold it.
    held = anchors.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    of_text = anchors.join(held.where("low <> high").select("h"), "h").groupBy("doc_id")
    of_text = of_text.agg(F.collect_list(F.struct("h", "first", "last")).alias("parts"))
    joined = texts.where(F.length("text") >= need).join(of_text.hint("shuffle_hash"), "doc_id")
    contexts = write_once(_contexts(joined, need), "contexts")
    # Equal contexts of a task are one row before anything is shuffled.
    distinct = contexts.groupBy("h", "mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("context").alias("context"))
    distinct = write_once(distinct, "distinct")
    hot = write_once(distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot_contexts).select("h"), "hot")
    number = hot.count()
    if number:
        those = F.broadcast(hot) if number * 8 <= HOT_BYTES else hot
        windows, distinct = _windows(distinct.join(those, "h", "left_semi"), need), distinct.join(those, "h", "left_anti")
    sharded = distinct.select("h", "mark", "low", "high", "context").repartition("h").sortWithinPartitions("h")
    found = sharded.mapInArrow(_search(need), "h long, mark binary, begins array<int>, ends array<int>")
    if number:
        found = found.unionByName(windows)
    back = contexts.select("h", "mark", "doc_id", "first").join(found, ["h", "mark"])
    spans = back.select(
        "doc_id",
        F.explode(F.arrays_zip("begins", "ends")).alias("span"),
        F.col("first"),
    ).select("doc_id", (F.col("first") + F.col("span.begins")).alias("begin"), (F.col("first") + F.col("span.ends")).alias("end"))
    return _merged(spans)


def _merged(spans: DataFrame) -> DataFrame:
    """Unite overlapping or touching spans of each document."""
    by_begin = Window.partitionBy("doc_id").orderBy("begin", "end")
    reach = F.max("end").over(by_begin.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach >= F.col("begin"), 0).otherwise(1)).over(by_begin.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.select("doc_id", "begin", "end", island.alias("island"))
        .groupBy("doc_id", "island")
        .agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
        .drop("island")
    )


def _contexts(joined: DataFrame, need: int) -> DataFrame:
    """The text of each stretch with its mark."""
    each = joined.select("doc_id", "text", F.explode("parts").alias("part"))
    context = F.substr("text", F.col("part.first") + 1, F.col("part.last") - F.col("part.first") + need)
    each = each.select(F.col("part.h").alias("h"), "doc_id", F.col("part.first").alias("first"), context.alias("context"))
    return each.withColumn("mark", _mark(F.col("context")))


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _windows(distinct: DataFrame, need: int) -> DataFrame:
    """What _search() finds, by the windows of single contexts: a window is shared if its text is another document's too."""
    start = F.explode(F.sequence(F.lit(0), F.length("context") - need)).alias("start")
    each = distinct.select("h", "mark", "low", "high", "context", start)
    each = each.select("h", "mark", "low", "high", "start", _mark(F.substr("context", F.col("start") + 1, F.lit(need))).alias("window"))
    shared = each.groupBy("window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("window")
    found = each.join(shared, "window").groupBy("h", "mark").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    # Windows in a row are one span.
    first = F.filter("starts", lambda x, i: (i == 0) | (F.get("starts", i - 1) < x - 1))
    last = F.filter("starts", lambda x, i: F.coalesce(F.get("starts", i + 1) > x + 1, F.lit(True)))
    return found.select("h", "mark", first.alias("begins"), F.transform(last, lambda x: x + need).alias("ends"))


def _search(need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        chars = 0

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            texts = table.column("context").to_pylist()
            low, high = (table.column(c).to_numpy() for c in ("low", "high"))
            which, begin, end = SharedTextIndex(texts, low, high).spans(need)
            order = np.argsort(which, kind="stable")
            rows, first = np.unique(which[order], return_index=True)
            offsets = pa.array(np.append(first, len(which)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int32())) for x in (begin, end)]
            got = table.take(pa.array(rows)).select(["h", "mark"]).combine_chunks()
            columns = [got.column(c).combine_chunks() if got.num_rows else pa.array([], got.schema.field(c).type) for c in ("h", "mark")]
            if got.num_rows:
                yield pa.RecordBatch.from_arrays([*columns, *lists], ["h", "mark", "begins", "ends"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            chars += pa.compute.sum(pa.compute.utf8_length(batch.column("context"))).as_py()
            while chars >= SHARD_CHARS:
                table = pa.Table.from_batches(held).combine_chunks()
                sizes = np.cumsum(pa.compute.utf8_length(table.column("context")).to_numpy())
                h = table.column("h").to_numpy()
                # Anchors stay whole: an index ends where the last anchor that fits ends.
                seams = np.flatnonzero(h[1:] != h[:-1]) + 1
                fits = seams[sizes[seams - 1] <= SHARD_CHARS]
                at = int(fits[-1]) if len(fits) else int(seams[0]) if len(seams) else 0
                if not at:
                    break
                yield from flush(table.slice(0, at))
                held = table.slice(at).combine_chunks().to_batches()
                chars = int(sizes[-1] - sizes[at - 1])
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    return run


def shared_share(documents: DataFrame, need: int = 200, **settings: int) -> DataFrame:
    """How much of each document is shared: rows (doc_id, shared_chars) of documents with a shared span."""
    spans = shared_spans(documents, need, **settings)
    return spans.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("shared_chars"))
