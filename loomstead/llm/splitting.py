"""Splitting oversized texts at natural boundaries, under their headings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.functions.text import strip, unix_lines
from loomstead.operators.headings import sections

#: Boundaries from the strongest on; each match ends where a cut may be.
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\n\s*", r"\n\s*", r"[.!?…][\"')\]»”’]*\s+|[。！？][」』”’]*", r"[;:,、，；：]\s*", r"\s+")]
#: Up to this rank a boundary ends a sentence at least.
_SENTENCE = 2


def _steady(text: str, at: int) -> int:
    """Not between a character and what modifies it."""
    for _ in range(32):
        if at <= 0 or at >= len(text) or not (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"):
            break
        at -= 1
    return at


def _snap(text: str, target: int, low: int, high: int) -> tuple[int, int]:
    """The strongest boundary from low to high, of equal ones the nearest to the target, and its rank; else the target."""
    for rank, pattern in enumerate(BOUNDARIES):
        ends = [m.end() for m in pattern.finditer(text, max(0, low - 1), min(len(text), high)) if low <= m.end() <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e)), rank
    return max(low, _steady(text, target)), len(BOUNDARIES)


def balanced_cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of a text: as few as fit, of nearly equal length, each end at a boundary.

    A piece is the text from `overlap` before the end of the piece before up to its own end. Each target divides what
    is left evenly into the least number of pieces; it is snapped to where its piece and all that follow still keep to
    the limit. Where that leaves only a place within a sentence, one more piece is allowed for if that gives a better.
    """
    n, room = len(text), limit - overlap
    reach = max(1, room // 6)
    cuts: list[int] = []
    begin = 0
    while n - begin > limit:
        least = -(-(n - begin - overlap) // room)
        best, at = len(BOUNDARIES) + 1, 0
        for count in (least, least + 1):
            target = begin + overlap + (n - begin - overlap) // count
            low = max(target - reach, n - (count - 1) * room, begin + overlap + 1)
            high = min(target + reach, begin + limit)
            found, rank = _snap(text, min(max(target, low), high), low, high)
            if rank < best:
                best, at = rank, found
            if best <= _SENTENCE:
                break
        cuts.append(at)
        begin = at - overlap
    return [*cuts, n]


def pieces(text: str, markdown: bool, limit: int, overlap: int) -> Iterator[tuple[str, str]]:
    """(breadcrumb, piece) of a text in order; no piece is longer than the limit."""
    for crumb, body in sections(text, markdown):
        begin = 0
        for end in balanced_cuts(body, limit, overlap):
            yield crumb, body[begin:end]
            begin = end - overlap


def split_texts(df: DataFrame, limit: int = 1800, overlap: int = 200, text: str = "text", markdown: str = "markdown") -> DataFrame:
    """Replace the text of each row by its pieces: the other columns and (ordinal, breadcrumb, piece).

    Lengths are in code points. Line ends become LF and outer white space goes first. Null and blank texts give no
    row; a text within the limit gives one piece for each section. Consecutive pieces of a section share exactly
    `overlap` characters; without them a section's pieces join to its body. Narrow: nothing is shuffled.
    """
    if not 0 <= overlap <= limit // 2:
        raise ValueError("the overlap must be at most half the limit")
    keep = [c for c in df.columns if c not in (text, markdown, "ordinal", "breadcrumb", "piece")]
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [T.StructField("ordinal", T.IntegerType()), T.StructField("breadcrumb", T.StringType()), T.StructField("piece", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ordinals, crumbs, parts, held = [], [], [], [], 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                made = [pa.array(ordinals, pa.int32()), pa.array(crumbs, pa.string()), pa.array(parts, pa.string())]
                own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
                return pa.RecordBatch.from_arrays([*own, *made], [*keep, "ordinal", "breadcrumb", "piece"])

            for i, (said, marked) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_markdown").to_pylist())):
                for n, (crumb, part) in enumerate(pieces(said, bool(marked), limit, overlap) if said else ()):
                    rows.append(i)
                    ordinals.append(n)
                    crumbs.append(crumb)
                    parts.append(part)
                    held += len(part)
                    if held > 8_000_000:
                        yield out()
                        rows, ordinals, crumbs, parts, held = [], [], [], [], 0
            yield out()

    clean = strip(unix_lines(F.col(text)))
    return df.select(*(f"`{c}`" for c in keep), clean.alias("_text"), F.col(markdown).alias("_markdown")).where("_text <> ''").mapInArrow(run, schema)
