"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; the rank as a fraction of the
source's rows puts all sources on one scale from 0 to 1. Sorted by that fraction, sources are
interleaved in proportion, so every run of rows has the mixture of the whole. Cut into runs of
equal count (law ``rows``: at most one apart), each shard matches it.

Neither sort is global. Rows are dealt into buckets by the leading part of the hash, counts per
(source, bucket) are summed up, and ranks are counted within a bucket; then the same again with
the leading part of the fraction. Hashes and fractions are even, so buckets are, whatever the
sources' sizes. The tables of counts have one row per bucket and source.

Cases: a null source is a source of its own; a null text has size 1; rows equal in id, size and
checksum may change places, which shows nowhere; equal texts are not kept together under this law;
with fewer rows than shards some shards are empty. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.session import stored

SHARDS = 16
SEED = 7
ROWS_PER_BUCKET = 50_000
MOST_BUCKETS = 1 << 16


def _ranked(rows: DataFrame, group: list[str], bucket: Column, order: list[str], rank: str) -> DataFrame:
    """``rows`` with a gapless rank from 0 within ``group`` by bucket and order, and the group's size."""
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(
        *group,
        "bucket",
        F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(*group)).alias("size_of_group"),
    )
    place = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(*order)) - 1
    return rows.withColumn("place", place).join(before, [*group, "bucket"]).withColumn(rank, F.col("before") + F.col("place")).drop("place", "before", "bucket")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("stratum"),
    )
    rows = stored(rows.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed))), "rows")
    total = rows.count()
    buckets = min(max(total // ROWS_PER_BUCKET, 1), MOST_BUCKETS)
    order = ["h", "doc_id", "size", "text_crc32"]
    ranked = _ranked(rows, ["stratum"], F.pmod(F.shiftright("h", 20), F.lit(buckets)), order, "rank")
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("size_of_group"))
    ranked = stored(ranked.withColumn("fraction", fraction).drop("size_of_group").withColumn("all", F.lit(0)), "ranked")
    leading = F.floor(F.col("fraction") * buckets)
    placed = _ranked(ranked, ["all"], leading, ["fraction", "stratum", *order], "at")
    shard = F.expr(f"at * {shards} div size_of_group")
    first = F.expr(f"(({shards} - 1) + (at * {shards} div size_of_group) * size_of_group) div {shards}")
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("at") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
