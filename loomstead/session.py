"""Session, table and checkpoint helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be sent to all executors at once.
BROADCAST_BYTES = 8 << 20


def local_session(cpus: int = 8, name: str = "loomstead") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOMSTEAD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files find the package, wherever the driver was started.

    On a cluster without such a share the package goes along with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns are pruned and filters pushed down by the planner."""
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that is unset, and only on a local master (tests), a folder of this machine is used.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="loomstead-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Compute a frame into a parquet table of the shared folder and read it again.

    Unlike checkpoint() this keeps columns prunable and compressed; the folder is removed with the session.
    """
    spark = df.sparkSession
    path = temporary(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_at = path
    return made


def discard(df: DataFrame) -> None:
    """Remove the table of a frame that write_once() gave, when nothing reads it any more; other frames stay as they are."""
    path = getattr(df, "_written_at", None)
    if path:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def temporary(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, removed with the session."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """A scan as it is, or, where it has fewer parts than there are cores, dealt out over these before heavy work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def rows_known_below(df: DataFrame, limit: int) -> bool:
    """Whether a frame has fewer than limit rows, reading no more of it than that takes."""
    return df.limit(limit).count() < limit


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A frame marked to be sent to all executors if its bytes, counted, are few; else as it is."""
    wide = [F.sum(F.octet_length(F.col(f"`{f.name}`"))) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    counted = df.agg(F.count("*"), *wide).first()
    return F.broadcast(df) if counted[0] * 16 * (1 + len(df.columns)) + sum(x or 0 for x in counted[1:]) <= most else df
