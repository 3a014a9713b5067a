"""Small helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.session import shared_dir

#: Bytes that part words: space and \t \n \v \f \r (``bytes.split()`` parts at the same six).
BLANK = "[ \\t-\\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers ``rows`` at a time, so that their memory is bounded by that
    many texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shrunk(text: Column) -> Column:
    """A text as compressed bytes, for shuffles of whole texts; null stays null."""

    @F.pandas_udf(T.BinaryType())
    def of(texts: pd.Series) -> pd.Series:
        pack = zstandard.ZstdCompressor(level=1).compress
        return texts.map(lambda t: None if t is None else pack(t.encode()))

    return of(text)


def grown(packed: bytes | None) -> str | None:
    return None if packed is None else zstandard.ZstdDecompressor().decompress(packed).decode()


def held(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder, with its partitions as they are."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, made longer until ``df`` has no such column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def column(df: DataFrame, name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return df["`" + name.replace("`", "``") + "`"]


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open spans as maximal runs; touching spans become one."""
    runs: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
