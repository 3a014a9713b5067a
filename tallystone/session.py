"""Session helpers: a local builder for tests and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "spark.tallystone.scratch.dir"
#: Ids and hashes are most of what tables and scratch copies hold: texts of hex digits, which need a codec with entropy coding.
CODEC = "zstd"


def local_session(cores: str = "8", app: str = "tallystone") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, as the cluster names it.

    Where it is unset, a local session gets a temporary folder of its own, kept under a
    setting of this library (the cluster's setting can't be changed at run time)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(OWN_DIR, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of a write that is run inside as soon as it is done; else they stay until the
    driver happens to collect its garbage. The session's own setting is back afterwards."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that several outputs
    use one computation and a lost executor does not replay it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.option("compression", CODEC).parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.scratch = path
    return copy


def discard(copy: DataFrame) -> None:
    """Delete a ``stored`` copy that nothing reads any more: all that was made of it must be stored or returned as values."""
    spark = copy.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(copy.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
