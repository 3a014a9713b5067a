"""Keyed state of streams: RocksDB with changelog checkpoints, and results that are compacted."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
BATCH = "batch"


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk and checkpoint only its changes; the
    session's own settings are back afterwards."""
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to a folder of its own; a replayed batch overwrites what it wrote."""

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{BATCH}={batch_id}")

    return one


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The result folders by their last batch: ``batch=N``, or ``upto=N`` after a compaction."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(entry.getPath().getName()) for entry in files.listStatus(root)] if files.exists(root) else []
    done = {int(name.split("=")[1]): name for name in found if name.startswith("upto=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/{name}/_SUCCESS"))}
    since = max(done, default=-1)
    batches = {int(name.split("=")[1]): name for name in found if name.startswith(f"{BATCH}=")}
    return ({since: f"{path}/rows/{done[since]}"} if done else {}) | {n: f"{path}/rows/{name}" for n, name in batches.items() if n > since}


def results(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> DataFrame:
    """The latest row of every key over all micro-batches."""
    folders = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    rows = None
    for number, folder in sorted(folders.items()):
        part = spark.read.schema(schema).parquet(folder).withColumn(BATCH, F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    rest = [name for name in rows.columns if name not in (*keys, BATCH)]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("r"))
    return latest.select(*keys, "r.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str], schema: str, keep: int = 4) -> None:
    """Fold the results of all but the last ``keep`` micro-batches into one folder and drop what it replaces.

    The new folder counts once it is complete, so a reader sees the old folders or the new one; the last batches
    stay as they are, for one of them may be written again."""
    folders = _folders(spark, path)
    old = dict(sorted(folders.items())[: -keep or None]) if keep else folders
    if len(old) < 2:
        return
    last = max(old)
    rows = None
    for number, folder in sorted(old.items()):
        part = spark.read.schema(schema).parquet(folder).withColumn(BATCH, F.lit(number))
        rows = part if rows is None else rows.unionByName(part)
    rest = [name for name in rows.columns if name not in (*keys, BATCH)]
    rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("r")).select(*keys, "r.*").write.mode("overwrite").parquet(f"{path}/rows/upto={last}")
    for folder in old.values():
        gone = spark._jvm.org.apache.hadoop.fs.Path(folder)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def state_rows(progress: Sequence[dict]) -> int:
    """Rows that the state of a stream held after its last micro-batch."""
    return sum(operator["numRowsTotal"] for operator in progress[-1]["stateOperators"]) if progress else 0
