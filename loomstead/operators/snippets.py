"""The part of a text that shows most of what was asked for."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.operators.lexical import STOPWORDS

LENGTH = 700
_WORD = re.compile(r"[\w'-]+")


def snippet(text: str, words: Sequence[str], length: int = LENGTH) -> str:
    """A window that holds the most different words, of those the one where they stand closest, then the first."""
    if len(text) <= length:
        return text
    wanted = {w for w in words if len(w) > 1 and w not in STOPWORDS}
    hits = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text.casefold()) if m[0] in wanted] if wanted else []
    if not hits:
        return text[:length].strip() + "…"

    # A window of hits slides over the text; how often each word is in it, is kept.
    inside: Counter[str] = Counter()
    best, middle, stop = (0, 0), 0, 0
    for begin, _, word in hits:
        while stop < len(hits) and hits[stop][0] < begin + length:
            inside[hits[stop][2]] += 1
            stop += 1
        end = hits[stop - 1][1]
        if (len(inside), begin - end) > best or not middle:
            best, middle = (len(inside), begin - end), (begin + end) // 2
        inside[word] -= 1
        if not inside[word]:
            del inside[word]
    start = min(max(0, middle - length // 2), len(text) - length)
    cut = text[start : start + length].strip()
    return ("…" if start else "") + cut + ("…" if start + length < len(text) else "")


def snippets(text: Column, words: Column, length: int = LENGTH) -> Column:
    """snippet() of a column, for the few rows of a result."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, w, length) if t is not None else None for t, w in zip(texts, wanted)])

    return run(text, words)
