"""Sections of texts under their headings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions.text import word

#: Extensions of documents that have headings, the joint of a breadcrumb and its depth.
MARKDOWN_EXTENSIONS = (".md", ".mdx", ".markdown")
JOINT, DEPTH = " › ", 3
_HASHES = re.compile(r"(#{1,6})\s+(\S.*)")
_RULE = re.compile(r"\s*(=+|--+)\s*")
_FENCE = re.compile(r"\s*(```|~~~)")


def sections(text: str, markdown: bool) -> Iterator[tuple[str, str]]:
    """(breadcrumb, body) of each section with a body that isn't blank; bodies without outer white space.

    Without markdown the text is one section. Of nested headings the topmost DEPTH make the breadcrumb.
    """
    if not markdown:
        if text.strip():
            yield "", text.strip()
        return
    path: list[tuple[int, str]] = []
    body: list[str] = []
    fence = ""
    lines = text.split("\n")
    skip = False

    def whole() -> tuple[str, str] | None:
        said = "\n".join(body).strip()
        body.clear()
        return (JOINT.join(t for _, t in path[:DEPTH]), said) if said else None

    for line, after in zip(lines, [*lines[1:], ""]):
        if skip:
            skip = False
            continue
        mark = _FENCE.match(line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1] == fence:
                fence = ""
        level, title = 0, ""
        if not fence and not mark:
            if hashes := _HASHES.fullmatch(line):
                level, title = len(hashes[1]), hashes[2].rstrip().rstrip("#").strip()
            elif line.strip() and line[0] not in "-*+>|" and (rule := _RULE.fullmatch(after)):
                level, title, skip = (1 if rule[1][0] == "=" else 2), line.strip(), True
        if not title:
            body.append(line)
            continue
        if ended := whole():
            yield ended
        while path and path[-1][0] >= level:
            path.pop()
        path.append((level, title))
    if ended := whole():
        yield ended


def has_headings(source: Column, metadata: Column, title: Column) -> Column:
    """Whether a document is one of a project in a markup with headings, by its extension."""
    suffix = F.regexp_extract(F.coalesce(title, F.lit("")), r"[^/\\](\.[^./\\]+)$", 1)
    extension = F.lower(F.coalesce(F.nullif(F.try_element_at(metadata, F.lit("extension")), F.lit("")), suffix))
    return (word(source) == "projects") & extension.isin(*MARKDOWN_EXTENSIONS)
