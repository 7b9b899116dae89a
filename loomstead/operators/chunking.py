"""Chunks of documents: whole paragraphs where they fit, under the headings they share; and dialogue units."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, groupby, takewhile
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.functions.text import strip, unix_lines
from loomstead.operators.headings import JOINT, sections
from loomstead.session import spread

# Sizes of chunks and of dialogue units.
TARGET, OVERLAP, LEAST_TARGET = 1800, 200, 100
UNIT_CHARS, UNIT_MESSAGES, UNIT_GAP = 24_000, 12, dt.timedelta(minutes=30)
LEAST_SHARED, MOST_SHARED = 16, 4_000
HEADER = re.compile(r"^(USER|ASSISTANT) \[([^\]\r\n]+)\]\n", re.M)


def words_within(text: str, size: int) -> Iterator[str]:
    """Cut a paragraph at its last blank within the size, or in a word if that would leave less than half."""
    at, text = 0, text.strip()
    while len(text) - at > size:
        blank = text.rfind(" ", at, at + size + 1)
        end = blank if blank - at >= size // 2 else at + size
        yield text[at:end].strip()
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    if at < len(text):
        yield text[at:]


def closing_words(text: str, size: int) -> str:
    """The whole words among the last characters of a text."""
    start = max(0, len(text) - max(0, size))
    if start:
        start = text.find(" ", start) + 1 or start
    return text[start:].strip() if size > 0 else ""


def pack(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole paragraphs up to the target; each begins with the closing words of the one before if they fit.

    No chunk is longer than target + overlap; a text without content gives none.
    """
    if target < LEAST_TARGET:
        raise ValueError(f"the target must be at least {LEAST_TARGET}")
    overlap = max(0, min(overlap, target // 2))
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    paragraphs = (p.strip() for p in re.split(r"\n\s*\n+", text))
    units = (u for p in paragraphs if p for u in ([p] if len(p) <= target else words_within(p, target)))
    done: list[str] = []
    now = ""
    for unit in units:
        if not now:
            now = unit
        elif len(now) + 2 + len(unit) <= target:
            now += "\n\n" + unit
        else:
            done.append(now.strip())
            before = closing_words(now, overlap)
            fits = before and len(before) + 2 + len(unit) <= target + overlap
            now = f"{before}\n\n{unit}" if fits else unit
    return [*done, now.strip()] if now.strip() else done


def shared_path(crumbs: Sequence[str]) -> str:
    """The headings all have in common, else those of the first."""
    paths = [c.split(JOINT) if c else [] for c in crumbs]
    common = [level[0] for level in takewhile(lambda level: len(set(level)) == 1, zip(*paths))]
    return JOINT.join(common) or (crumbs[0] if crumbs else "")


def pack_sections(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """(breadcrumb, chunk): short sections in a row together, a long one by itself in paragraphs."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    parts = list(sections(text, True))
    if not parts:
        return [("", c) for c in pack(text, target, overlap)] if text else []
    out: list[tuple[str, str]] = []
    row: list[tuple[str, str]] = []

    def close() -> None:
        if row:
            out.append((shared_path([c for c, _ in row]), "\n\n".join(b for _, b in row)))
            row.clear()

    for crumb, body in parts:
        if len(body) > target:
            close()
            out += [(crumb, c) for c in pack(body, target, overlap)]
            continue
        if sum(len(b) + 2 for _, b in row) + len(body) > target:
            close()
        row.append((crumb, body))
    close()
    return out


def chunk_documents(df: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """From (document_id, text, markdown) to (document_id, ordinal, breadcrumb, content); null texts give no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ordinals, crumbs, parts = [], [], [], []
            for i, text, marked in zip(*(batch.column(c).to_pylist() for c in ("document_id", "text", "markdown"))):
                made = pack_sections(text, target, overlap) if marked else [("", c) for c in pack(text, target, overlap)]
                for n, (crumb, part) in enumerate(made):
                    ids.append(i)
                    ordinals.append(n)
                    crumbs.append(crumb)
                    parts.append(part)
            columns = [pa.array(ids, pa.string()), pa.array(ordinals, pa.int32()), pa.array(crumbs, pa.string()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "ordinal", "breadcrumb", "content"])

    rows = spread(df.select("document_id", strip(unix_lines(F.col("text"))).alias("text"), "markdown").where("text <> ''"))
    return rows.mapInArrow(run, "document_id string, ordinal int, breadcrumb string, content string")


@dataclass(frozen=True)
class Block:
    role: str
    at: dt.datetime
    raw: str
    start: int
    end: int


def shared_end(text: str, part: str) -> int:
    """How many characters the longest end of a text is long that a part begins with; fewer than LEAST_SHARED count as none."""
    seed = part[:LEAST_SHARED]
    at = text.find(seed, max(0, len(text) - min(len(part), MOST_SHARED))) if len(seed) == LEAST_SHARED else -1
    while at >= 0 and not part.startswith(text[at:]):
        at = text.find(seed, at + 1)
    return len(text) - at if at >= 0 else 0


def joined(parts: Sequence[str]) -> tuple[str, list[tuple[int, int]]]:
    """A text of its overlapping chunks, and where each lies in it: the longest shared end and beginning is one."""
    pieces: list[str] = []
    places: list[tuple[int, int]] = []
    size, end = 0, ""
    for part in parts:
        shared = shared_end(end, part)
        added = part[shared:] if shared or not size else "\n\n" + part
        pieces.append(added)
        size += len(added)
        places.append((size - len(part), size))
        # No more of the end can be shared with what comes.
        end = (end + added)[-MOST_SHARED:]
    return "".join(pieces), places


def _time(text: str) -> dt.datetime:
    try:
        at = dt.datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        at = dt.datetime(1970, 1, 1)
    return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def blocks(text: str, most: int = UNIT_CHARS) -> Iterator[Block]:
    """The messages of a dialogue text; one longer than a unit comes in slices, each under its header."""
    heads = list(HEADER.finditer(text))
    for head, after in zip(heads, [*heads[1:], None]):
        end = after.start() if after else len(text)
        said = text[head.end() : end].strip()
        at, role = _time(head[2]), head[1].lower()
        if not said:
            continue
        if end - head.start() <= most or len(text[head.start() : end].strip()) <= most:
            yield Block(role, at, text[head.start() : end].strip(), head.start(), end)
            continue
        header = f"{head[1]} [{at.isoformat().replace('+00:00', 'Z')}]\n"
        room = max(1000, most - len(header))
        for i in range(0, len(said), room):
            if part := said[i : i + room].strip():
                yield Block(role, at, header + part, head.start(), end)


def _numbers(of: Sequence[Block], most: int) -> list[int]:
    """The unit of each block: a pause, the number of messages or the length begins the next."""

    def step(state: tuple, b: Block) -> tuple:
        number, held, chars, at = state
        full = held >= UNIT_MESSAGES or chars + 2 + len(b.raw) > most
        if at is None or full or b.at - at > UNIT_GAP:
            return number + 1, 1, len(b.raw), b.at
        return number, held + 1, chars + 2 + len(b.raw), b.at

    return [s[0] for s in accumulate(of, step, initial=(-1, 0, 0, None))][1:]


def units(text: str, places: Sequence[tuple[int, int]] = (), most: int = UNIT_CHARS) -> list[tuple[str, str, int, int]]:
    """Units of a dialogue (text, hash, first and last chunk): closed by a pause, by messages or by length.

    A unit's chunks are those that it overlaps; where none does, the one that begins nearest.
    """
    found = list(blocks(text, most))
    begins, ends = [b for b, _ in places], list(accumulate((e for _, e in places), max))
    out = []
    for _, group in groupby(zip(_numbers(found, most), found), key=itemgetter(0)):
        own = [b for _, b in group]
        said = "\n\n".join(b.raw for b in own).strip()
        first, last = bisect_right(ends, own[0].start), bisect_left(begins, own[-1].end) - 1
        if first > last:
            near = min(range(len(places)), key=lambda n: abs(begins[n] - own[0].start), default=0)
            first, last = near, near
        out.append((said, hashlib.sha256(said.encode()).hexdigest(), first, last))
    return out


def dialogue_units(chunks: DataFrame, most: int = UNIT_CHARS) -> DataFrame:
    """From (document_id, ordinal, content) to (document_id, unit, text, input_hash, first_ordinal, last_ordinal).

    A document is put together from its chunks in one task, as a document is what a unit is part of.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("ordinal")
        text, places = joined(rows.column("content").to_pylist())
        ordinals = rows.column("ordinal").to_pylist()
        made = units(text, places, most)
        columns = [
            [key[0].as_py()] * len(made), list(range(len(made))), [u[0] for u in made], [u[1] for u in made],
            [ordinals[u[2]] for u in made], [ordinals[u[3]] for u in made],
        ]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = ["document_id", "unit", "text", "input_hash", "first_ordinal", "last_ordinal"]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "document_id string, unit int, text string, input_hash string, first_ordinal int, last_ordinal int"
    return chunks.select("document_id", "ordinal", "content").groupBy("document_id").applyInArrow(run, schema)
