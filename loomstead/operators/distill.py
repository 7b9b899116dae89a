"""Summaries of dialogue units: an extractive distiller, their validation, and their search text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions.redact import redact
from loomstead.functions.text import strip

# The fields of a summary with the most characters of each; of lists, items have so many and a list so many items.
TEXTS = {"user_goal": 500, "summary": 1200, "outcome": 500}
LISTS = {"decisions": 300, "artifacts": 300, "systems": 300, "open_questions": 300, "keywords": 100}
MOST_ITEMS = 12
NO_ANSWER = r"(?i)\b(?:no|without)\s+(?:assistant|agent)?\s*response\b|\bonly\s+the\s+user(?:'s)?\s+(?:initial\s+)?(?:question|message)\b"


def validated(s: Column) -> Column:
    """A summary struct with texts redacted, stripped and cut, and lists without blank items."""
    texts = [F.substring(strip(redact(s[k])), 1, n).alias(k) for k, n in TEXTS.items()]
    return F.struct(*texts, *(_items(s[k], n).alias(k) for k, n in LISTS.items()))


def _items(items: Column, most: int) -> Column:
    kept = F.filter(items, lambda x: strip(x) != "")
    return F.slice(F.transform(kept, lambda x: F.substring(strip(redact(x)), 1, most)), 1, MOST_ITEMS)


def consistent(s: Column, evidence: Column) -> Column:
    """Claims that nobody answered are dropped where the evidence has an answer."""
    answered = evidence.rlike(r"(?m)^ASSISTANT\s+\[")
    kept = lambda k, other: F.when(answered & s[k].rlike(NO_ANSWER), other).otherwise(s[k]).alias(k)
    return F.struct(s["user_goal"], kept("summary", F.lit("")), kept("outcome", F.lit(None).cast("string")), *(s[k].alias(k) for k in LISTS))


def flattened(s: Column) -> Column:
    """The search text of a summary: a line for each field that isn't empty, in order."""
    name = lambda k: k.replace("_", " ").title() + ": "
    texts = [F.when(F.coalesce(s[k], F.lit("")) != "", F.concat(F.lit(name(k)), s[k])) for k in TEXTS]
    lists = [F.when(F.size(s[k]) > 0, F.concat(F.lit(name(k)), F.array_join(s[k], "; "))) for k in LISTS]
    return strip(redact(F.array_join(F.array_compact(F.array(*texts, *lists)), "\n")))


def extract(units: DataFrame) -> DataFrame:
    """Add `distilled` to units (text): first request as goal, first answer as summary, capitals and paths as lists."""
    said = lambda role: strip(F.regexp_extract("text", rf"(?s){role} \[[^\]\n]+\]\n(.*?)(?=\n\n(?:USER|ASSISTANT) \[|\z)", 1))
    last = F.element_at(F.split("text", r"(?m)^ASSISTANT \[[^\]\n]+\]\n"), -1)
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))))
    made = F.struct(
        said("USER").alias("user_goal"),
        said("ASSISTANT").alias("summary"),
        strip(last).alias("outcome"),
        F.array().cast("array<string>").alias("decisions"),
        found(r"\b[\w./-]+\.(?:py|md|mdx|txt|json|toml|sh)\b").alias("artifacts"),
        found(r"\b[a-z]+\.[a-z]+\b").alias("systems"),
        found(r"[A-Z][^.?!\n]*\?").alias("open_questions"),
        found(r"\b[A-Z]{3,}-\d+\b").alias("keywords"),
    )
    return units.withColumn("distilled", made).withColumn("distilled", consistent(validated(F.col("distilled")), F.col("text")))
