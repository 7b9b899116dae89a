"""Encoding whole text columns with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomstead.llm.bpe import encoder, vocabulary_path
from loomstead.session import spread

#: Characters handled at once in a worker; bounds its memory whatever the size of a batch or a text.
CHARS_AT_ONCE = 1_000_000


def cut_long(text: str, most: int = CHARS_AT_ONCE) -> list[str]:
    """Cut a very long text where a piece must begin anyway: before a single blank between two visible characters.

    A text without such a place stays whole.
    """
    if len(text) <= most:
        return [text]
    parts, begin = [], 0
    while len(text) - begin > most:
        at = text.find(" ", begin + most)
        while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0 or at >= len(text) - 1:
            break
        parts.append(text[begin:at])
        begin = at
    return [*parts, text[begin:]]


def _encoded(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row, each text's number of ids, and which texts are null."""
    coder = encoder(path)
    values = texts.to_pylist()
    counts = np.zeros(len(values), np.int64)
    flats: list[np.ndarray] = []
    group: list[str] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if group:
            flat, ends = coder.encode_batch(group)
            np.add.at(counts, owners, np.diff(ends, prepend=0))
            flats.append(flat)
            group.clear()
            owners.clear()
            held = 0

    for i, text in enumerate(values):
        for part in cut_long(text) if text else ():
            group.append(part)
            owners.append(i)
            held += len(part)
            if held >= CHARS_AT_ONCE:
                flush()
    flush()
    flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    return flat, counts, np.array([v is None for v in values], bool)


def encode_column(
    df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """Add the token ids of a text column, without special tokens.

    Null text gives null, empty text an empty list; blank text is text like any other. Strings of special tokens
    in a text are ordinary text. Narrow: no shuffle, one pass, memory bounded by CHARS_AT_ONCE and the longest
    text without a cuttable place. A column already named as the new one is replaced.
    """
    path = vocabulary_path(vocabulary, folder)
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch, text):
                flat, counts, null = _encoded(path, part.column(text))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return spread(df.select(*_named(keep), f"`{text}`")).mapInArrow(run, schema)


def count_column(
    df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str = "byte_bpe_50k", folder: str | None = None
) -> DataFrame:
    """Add the number of token ids of a text column and drop the text; null counts 0."""
    path = vocabulary_path(vocabulary, folder)
    keep = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch, text):
                counts = _encoded(path, part.column(text))[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(counts)], [*keep, out])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType())])
    return spread(df.select(*_named(keep), f"`{text}`")).mapInArrow(run, schema)


def _named(columns: list[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _sliced(batch: pa.RecordBatch, text: str, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts together stay under a size, single long texts apart."""
    if batch.num_rows == 0:
        return
    column = batch.column(text)
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(column).to_numpy(zero_copy_only=False), np.float64))
    begin, held = 0, 0.0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0.0
        held += size
    yield batch.slice(begin)
