"""Processing only what is new or changed, against a persisted state of keys and content hashes.

A state is a folder. Its rows (key columns, content_hash) lie in buckets by a hash of the key; a version is a small
numbered file that names the folder of each bucket. The version in force is the one of the greatest number, and a new
one is put beside it by one rename that fails if the number is taken, so that of two writers only one wins. A run
writes what it hands out under the next number before anything is processed, and rewrites only the buckets it changed.

A run that fails before its rows are written leaves no trace. One that fails later is taken up by the next run, which
first hands out the very same rows under the same number: a consumer that keeps a number's output once (such as
`append_once`) sees every record once, whatever failed in between.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.text import is_blank, strip, word
from loomstead.session import small, table

#: Buckets of a state; about as many as make some hundred megabytes each.
BUCKETS = 32


class Overtaken(RuntimeError):
    """Another run has put the same version into force before this one."""


class KeyHashState:
    """Versions of (keys..., content_hash) under a folder that all executors and later runs share."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = ", ".join(f"`{k}` string" for k in keys) + ", content_hash string"
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, prefix: str) -> list[str]:
        if not self._files.exists(self._path("")):
            return []
        found = (x.getPath().getName() for x in self._files.listStatus(self._path("")))
        return sorted(n for n in found if n.startswith(prefix) and not n.endswith(".new"))

    def number(self) -> int:
        """The number of the version in force, 0 before the first run."""
        names = self._names("version-")
        return int(names[-1].removeprefix("version-")) if names else 0

    def _version(self, number: int) -> dict:
        if not number:
            return {"buckets": self.buckets, "folders": {}}
        lines = self.spark.read.text(f"{self.folder}/version-{number:012d}").collect()
        return json.loads("".join(r[0] for r in lines))

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/{f}/bucket={b}" for b, f in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows of the version in force."""
        return self._read(self._version(self.number())["folders"])

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def changed(self, rows: DataFrame) -> DataFrame:
        """Of rows with one row for each key and a content_hash: those whose key is new or whose hash differs."""
        known = self.read().select(*self.keys, F.col("content_hash").alias("_known"))
        return rows.join(known, self.keys, "left").where(~F.col("content_hash").eqNullSafe(F.col("_known"))).drop("_known")

    def move(self, rows: DataFrame, base: int) -> None:
        """Put the version after `base` into force, in which the rows (one for each key) are known.

        Only buckets that the rows fall into are written again. Raises Overtaken if that version is there already.
        """
        if self.number() != base:
            raise Overtaken(f"version {base + 1} of {self.folder} is in force already")
        version = self._version(base)
        new = rows.select(*self.keys, F.col("content_hash").alias("_new"), self._bucket(version["buckets"]).alias("bucket"))
        touched = {str(r.bucket) for r in new.select("bucket").distinct().collect()}  # at most all buckets
        held = self._read({b: f for b, f in version["folders"].items() if b in touched})
        both = held.join(new.drop("bucket"), self.keys, "full").select(*self.keys, F.coalesce("_new", "content_hash").alias("content_hash"))
        folder = f"rows-{base + 1:012d}-{uuid.uuid4().hex}"
        bucket = self._bucket(version["buckets"])
        both.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{folder}")
        self._commit(base + 1, {**version, "folders": {**version["folders"], **dict.fromkeys(touched, folder)}})
        self._clean()

    def _commit(self, number: int, version: dict) -> None:
        new = self._path(f"version-{number:012d}.{uuid.uuid4().hex}.new")
        out = self._files.create(new, True)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf)
        how = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        how[0] = self._hadoop.Options.Rename.NONE
        at = self._files.makeQualified(self._path(f"version-{number:012d}"))
        try:
            context.rename(self._files.makeQualified(new), at, how)
        except Exception as e:
            self._files.delete(new, False)
            if self._files.exists(at):
                raise Overtaken(f"version {number} of {self.folder} is in force already") from e
            raise

    def _clean(self) -> None:
        """Remove what neither the version in force nor the one before it needs."""
        last = self.number()
        used = {f for n in (last - 1, last) if n > 0 for f in self._version(n)["folders"].values()}
        for name in self._names("rows-"):
            if name not in used and int(name.split("-")[1]) <= last:
                self._files.delete(self._path(name), True)
        for prefix, keep in (("version-", last - 1), ("handed-", last)):
            for name in self._names(prefix):
                if int(name.split("-")[1].split(".")[0]) < keep:
                    self._files.delete(self._path(name), True)

    def _handed(self, number: int) -> DataFrame | None:
        """What a run handed out under a number, if it was written completely."""
        name = f"handed-{number:012d}"
        return self.spark.read.parquet(f"{self.folder}/{name}") if self._files.exists(self._path(f"{name}/_SUCCESS")) else None

    def run(self, rows: DataFrame, process: Callable[[DataFrame, int], object]) -> None:
        """Process what is new or changed: process(rows, number); the state moves on only when that has succeeded.

        What an earlier run handed out without ending comes first, as it was, under its number.
        """
        number = self.number() + 1
        waiting = self._handed(number)
        if waiting is not None:
            process(waiting, number)
            self.move(waiting, number - 1)
            number += 1
        # Written down once, so that a source that isn't fixed can't give the consumer and the state different rows.
        self.changed(rows).write.mode("overwrite").parquet(f"{self.folder}/handed-{number:012d}")
        handed = self._handed(number)
        process(handed, number)
        self.move(handed, number - 1)


def append_once(folder: str) -> Callable[[DataFrame, int], None]:
    """A consumer that keeps each number's rows once, in a folder of its own under batch=<number>."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text without outer white space."""
    return F.sha2(strip(text), 256)


def plain_hash(stored: Column) -> Column:
    """A stored hash regardless of letter case, outer blanks and a sha256: prefix."""
    return F.regexp_replace(word(stored), "^sha256:", "")


def rows_since_success(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows delivered by runs that started after the last successful run of the rows' source.

    A run is successful if it says so and has a watermark. A source without one takes all its runs; rows of an
    unknown run, or of one without a start, are not taken. Repeated rows of a run count once.
    """
    last = runs.where(F.col("successful") & F.col("watermark").isNotNull()).groupBy(word(F.col("source")).alias("source"))
    last = last.agg(F.max("started_at").alias("_last"))
    starts = runs.where(F.col("started_at").isNotNull()).groupBy("run_id").agg(F.max("started_at").alias("_started"))
    last, starts = small(last), small(starts)
    joined = rows.join(starts, "run_id").join(last, "source", "left")
    return joined.where(F.col("_last").isNull() | (F.col("_started") > F.col("_last"))).drop("_last", "_started")


def latest_versions(rows: DataFrame) -> DataFrame:
    """Of each document the row of the latest timestamp (none counts as earliest), ties to the largest row_id.

    Only hashes move in the shuffle, not texts; each task sends one row of a document.
    """
    narrow = rows.select(
        "source",
        "source_key",
        F.struct(
            F.col("timestamp"), F.col("row_id"), content_hash(F.col("text")).alias("content_hash"), is_blank(F.col("text")).alias("blank")
        ).alias("v"),
    )
    return narrow.groupBy("source", "source_key").agg(F.max("v").alias("v")).select("source", "source_key", "v.*")


def pending_documents(spark: SparkSession, sf_dir: str, state: KeyHashState) -> DataFrame:
    """Documents to process now: (source, source_key, row_id, content_hash)."""
    docs = table(spark, sf_dir, "ingest_documents").select(
        "row_id", word(F.col("source")).alias("source"), strip(F.col("source_key")).alias("source_key"), "text", "timestamp", "run_id"
    )
    fresh = latest_versions(rows_since_success(docs, table(spark, sf_dir, "scan_runs"))).where(~F.col("blank"))
    return state.changed(fresh)


def stored_state(spark: SparkSession, sf_dir: str, folder: str) -> KeyHashState:
    """The store's present contents as the state in force."""
    state = KeyHashState(spark, folder, ["source", "source_key"])
    stored = table(spark, sf_dir, "stored_documents").select(
        word(F.col("source")).alias("source"), strip(F.col("source_key")).alias("source_key"), plain_hash(F.col("content_hash")).alias("content_hash")
    )
    state.move(stored.groupBy("source", "source_key").agg(F.max("content_hash").alias("content_hash")), 0)
    return state
