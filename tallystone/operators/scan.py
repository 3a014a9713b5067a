"""Running sums that survive a hot key.

A window over ``keys`` puts all rows of a key in one task. Here a key that holds more
than its share is cut into consecutive pieces first: ``split_points`` samples the
order values of such keys (the sample only places the cuts, every row is kept), each
row gets its piece number, windows run per (keys, piece), and a small table carries
the sums of the earlier pieces. Without hot keys everything is a plain window.

The helper tables are bounded whatever the data size: a key is only cut when it holds
more than 1/MAX_PIECES of all rows, so there are at most MAX_PIECES hot keys and about
as many cuts in total. That bound is what makes collecting the hot keys and
broadcasting the cuts safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.session import stored

PIECE = "_piece"
MAX_PIECES = 8192
MIN_ROWS = 1_000_000
SAMPLES_PER_CUT = 16
BLOCK = 64
QUANTITY_SUM = "decimal(28,8)"


def order_value(order: Sequence[str]) -> Column:
    return F.struct(*(F.col(name) for name in order))


def in_blocks(cuts: Column) -> Column:
    """Sorted cuts as an array of arrays, for a two-step lookup."""
    starts = F.sequence(F.lit(1), F.size(cuts), F.lit(BLOCK))
    return F.transform(starts, lambda start: F.slice(cuts, start, F.lit(BLOCK)))


def split_points(
    profile: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    min_rows: int | None = None,
    max_pieces: int | None = None,
    counts: DataFrame | None = None,
) -> DataFrame | None:
    """Cuts of the hot keys (``keys`` plus ``cuts``), or None when no key is hot.

    ``profile`` may be any cheap superset of the rows that will be scanned; cuts need not
    be exact for the result to be. ``counts`` (``keys`` plus ``count``), where they are stored already, save its first scan."""
    min_rows = MIN_ROWS if min_rows is None else min_rows
    max_pieces = MAX_PIECES if max_pieces is None else max_pieces
    if counts is None:
        counts = stored(profile.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")), "key-counts")
    piece_rows = max(min_rows, -(-(counts.agg(F.sum("count")).first()[0] or 0) // max_pieces))
    hot = counts.where(F.col("count") > piece_rows).select(*keys)
    hot_keys = hot.collect()  # at most max_pieces rows: each has more than 1/max_pieces of all
    if not hot_keys:
        return None
    hot_keys = profile.sparkSession.createDataFrame(hot_keys, hot.schema)
    samples_per_cut = min(SAMPLES_PER_CUT, piece_rows)
    step = max(1, piece_rows // samples_per_cut)
    sample = (
        profile.select(*keys, *order)
        .join(F.broadcast(hot_keys), list(keys))
        .where(F.pmod(F.xxhash64(*order), F.lit(step)) == 0)
    )
    cuts = (
        sample.groupBy(*keys)
        .agg(F.array_sort(F.collect_set(order_value(order))).alias("_sorted"))
        .select(*keys, F.filter("_sorted", lambda _, i: F.pmod(i + 1, F.lit(samples_per_cut)) == 0).alias("cuts"))
        .where(F.size("cuts") > 0)
        .select(*keys, in_blocks(F.col("cuts")).alias("cuts"))
    )
    return stored(cuts, "cuts")


def piece_keys(keys: Sequence[str], cuts: DataFrame | None) -> list[str]:
    """What windows partition by: the keys, and the piece when there are cuts. The last key comes
    first, for sorts compare by the first one and few accounts share many instruments."""
    return list(reversed(keys)) if cuts is None else [*reversed(keys), PIECE]


def with_pieces(df: DataFrame, keys: Sequence[str], value: Column, cuts: DataFrame | None) -> DataFrame:
    """Add the piece number: how many cuts lie strictly before ``value``."""
    if cuts is None:
        return df
    joined = df.join(F.broadcast(cuts), list(keys), "left").withColumn("_at", value)
    before = F.size(F.filter("cuts", lambda block: block[0] < F.col("_at")))
    inside = F.size(F.filter(F.try_element_at("cuts", before), lambda cut: cut < F.col("_at")))
    piece = F.when(F.col("cuts").isNull() | (before == 0), 0).otherwise((before - 1) * BLOCK + inside)
    return joined.withColumn(PIECE, piece).drop("cuts", "_at")


def hot_rows(df: DataFrame, keys: Sequence[str], cuts: DataFrame) -> DataFrame:
    return df.join(F.broadcast(cuts.select(*keys)), list(keys), "left_semi")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    cuts: DataFrame | None,
    totals: bool = False,
    sum_type: str = QUANTITY_SUM,
) -> DataFrame:
    """Add inclusive running sums in ``order`` (and with ``totals`` the sum over the whole
    key as ``<name>_total``). With cuts, ``df`` must carry its piece number."""
    pieces = Window.partitionBy(*piece_keys(keys, cuts))
    running = pieces.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {name: F.sum(value).over(running).cast(sum_type) for name, value in sums.items()}
    if totals:  # in the same order, so that one pass over a key gives both
        whole_piece = running.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        added |= {f"{name}_total": F.sum(value).over(whole_piece).cast(sum_type) for name, value in sums.items()}
    local = df.withColumns(added)
    if cuts is None:
        return local
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    per_piece = (
        hot_rows(df, keys, cuts).groupBy(*keys, PIECE).agg(*(F.sum(value).alias(name) for name, value in sums.items()))
    )
    carried = per_piece.select(
        *keys,
        PIECE,
        *(F.sum(name).over(earlier).cast(sum_type).alias(f"_before_{name}") for name in sums),
        *(F.sum(name).over(whole).cast(sum_type).alias(f"_whole_{name}") for name in sums),
    )
    joined = local.join(F.broadcast(carried), [*keys, PIECE], "left")
    zero = F.lit(0).cast(sum_type)
    shifted = {name: (F.col(name) + F.coalesce(F.col(f"_before_{name}"), zero)).cast(sum_type) for name in sums}
    if totals:
        shifted |= {f"{name}_total": F.coalesce(f"_whole_{name}", f"{name}_total") for name in sums}
    return joined.withColumns(shifted).drop(*(f"_{part}_{name}" for part in ("before", "whole") for name in sums))
