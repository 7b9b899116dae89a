"""Documents of project folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions that are read, folders that aren't, and names of secrets.
EXTENSIONS = (".md", ".mdx", ".txt")
EXCLUDED = (
    ".git .hg .svn .idea .vscode .venv venv env node_modules bower_components vendor dist build target out coverage .coverage "
    ".pytest_cache .mypy_cache .ruff_cache __pycache__ .cache cache tmp temp logs log graphify-out .runtime .next .nuxt .turbo "
    ".parcel-cache generated secrets .secrets"
).split()
SECRET_NAMES = (
    ".env credential credentials secret secrets token tokens password passwd id_rsa id_ed25519 service-account service_account auth.json"
).split()
SECRET_WORDS = "credential credentials secret secrets passwd pwd id_rsa id_ed25519 rsa ed25519".split()
MOST_BYTES = 2_000_000


def looks_secret(name: Column) -> Column:
    """Whether a file name is that of a credential store: whole, by its stem, or by a word of it."""
    low = F.lower(name)
    stem = F.regexp_replace(low, r"(?<=.)\.[^.]*$", "")
    words = F.split(stem, r"[._\-\s]+")
    named = F.array(*map(F.lit, SECRET_NAMES))
    return (
        F.array_contains(named, low)
        | F.array_contains(named, stem)
        | F.arrays_overlap(words, F.array(*map(F.lit, SECRET_WORDS)))
        | low.startswith(".env")
    )


def scan(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(source_key, project, title, text, ts, status) of the files below a folder; status is read or kept.

    Kept are files that can't be used now (too large, binary, blank) but must not count as gone. Files in excluded
    folders, of other extensions or with names of secrets aren't listed at all. Names are filtered before any
    content is read. Files without any byte aren't given by the reader; their keys must be kept by their listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    path = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    relative = F.substring(path, len(base) + 2, 1 << 30)
    parts = F.split(relative, "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    excluded = F.arrays_overlap(F.transform(folders, F.lower), F.array(*map(F.lit, EXCLUDED)))
    wanted = F.lower(name).rlike(r"\.(md|mdx|txt)$") & ~looks_secret(name) & ~F.coalesce(excluded, F.lit(False))
    fits = (F.col("length") > 0) & (F.col("length") <= most_bytes)
    head = F.hex(F.substring("content", 1, 8192))
    text = F.regexp_replace(F.when(fits, F.try_validate_utf8(F.col("content").cast("string"))), "^\ufeff", "")
    usable = fits & ~head.rlike("^(..)*00") & text.isNotNull() & (F.trim(text) != "")
    project = F.when(F.size(folders) > 0, parts[0]).otherwise(F.lit(base.rsplit("/", 1)[-1]))
    return files.where(wanted).select(
        F.lower(relative).alias("source_key"), project.alias("project"), name.alias("title"), F.when(usable, text).alias("text"),
        F.col("modificationTime").alias("ts"), F.when(usable, "read").otherwise("kept").alias("status"),
    )
