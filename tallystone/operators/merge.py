"""Ordered natural-key merges: ``merge(existing, batch) -> table``.

Applying batch rows one after the other, as an upsert statement would, is a fold over
each key in row order. Every rule below is written as aggregates over the key (first and
last row by order, last non-null value, any difference), so repeated keys combine
map-side and a key repeated very often needs no large group anywhere. Stored rows come
before batch rows in the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.schemas import NATURAL_KEYS

ORDER = ("created_at_utc", "source_raw_record_id")
_AT = "_at"


def _sequence(existing: DataFrame | None, batch: DataFrame, order: Sequence[str]) -> DataFrame:
    """Stored and new rows in one table with their place in the order."""
    places = [F.col(name).alias(f"p{i}") for i, name in enumerate(order)]
    new = batch.withColumn(_AT, F.struct(F.lit(1).alias("stored_first"), *places))
    if existing is None:
        return new
    kept = existing.select(*(F.col(n) if n in existing.columns else F.lit(None).cast(batch.schema[n].dataType).alias(n) for n in batch.columns))
    nothing = [F.lit(None).cast(batch.schema[name].dataType).alias(f"p{i}") for i, name in enumerate(order)]
    return kept.withColumn(_AT, F.struct(F.lit(0).alias("stored_first"), *nothing)).unionByName(new)


def _first(names: Sequence[str]) -> Column:
    return F.min_by(F.struct(*names), _AT).alias("first")


def _last(names: Sequence[str]) -> Column:
    return F.max_by(F.struct(*names), _AT).alias("last")


def _last_known(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(_AT))).alias(name)


def _first_known(name: str) -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(_AT))).alias(name)


def _differs(*names: str) -> Column:
    """Whether any two rows of the key disagree, which is the same as any neighbours disagreeing."""
    return ~F.min(F.struct(*names)).eqNullSafe(F.max(F.struct(*names)))


def _rest(df: DataFrame, *used: Sequence[str]) -> list[str]:
    taken = {_AT, *(name for names in used for name in names)}
    return [name for name in df.columns if name not in taken]


def merge_trades(existing: DataFrame | None, batch: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """First row wins, except commission, realized_pnl, net_cash and cost, which take the last value, nulls included."""
    keys = NATURAL_KEYS["event_trade_fill"]
    mutable = ["commission", "realized_pnl", "net_cash", "cost"]
    rows = _sequence(existing, batch, order)
    merged = rows.groupBy(*keys).agg(_first(_rest(rows, keys, mutable)), _last(mutable))
    return merged.select(*keys, "first.*", "last.*")


def merge_cashflows(existing: DataFrame | None, batch: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Last row wins; a known instrument is kept; any change of amount or date marks a correction for good."""
    keys = NATURAL_KEYS["event_cashflow"]
    rows = _sequence(existing, batch.withColumn("is_correction", F.lit(False)), order)
    flag = F.coalesce(F.bool_or("is_correction"), F.lit(False))
    last = _rest(rows, keys, ["instrument_id", "functional_currency", "is_correction"])
    merged = rows.groupBy(*keys).agg(
        _last(last),
        _first_known("functional_currency"),
        _last_known("instrument_id"),
        (flag | _differs("amount", "report_date_local")).alias("is_correction"),
    )
    return merged.select(*keys, "last.*", "functional_currency", "instrument_id", "is_correction")


def merge_fx(existing: DataFrame | None, batch: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Last values win, the source row stays the first seen."""
    keys = NATURAL_KEYS["event_fx"]
    last = ["report_date_local", "fx_rate", "fx_source", "provisional", "diagnostic_code"]
    rows = _sequence(existing, batch, order)
    merged = rows.groupBy(*keys).agg(_first(_rest(rows, keys, last)), _last(last))
    return merged.select(*keys, "first.*", "last.*")


CORP_ACTION_FALLBACK_KEY = ["account_id", "transaction_id", "conid", "report_date_local", "reorg_code"]


def merge_corp_actions(existing: DataFrame | None, batch: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Rows with an action id merge on it, rows without on the fallback key.

    Rows with neither action nor transaction id have no key; they belong to the
    violations (``corp_actions_without_key``) and are left out here."""
    rows = _sequence(existing, batch, order)
    with_id = _merge_identified_actions(rows.where(F.col("action_id").isNotNull()))
    without_id = _merge_fallback_actions(rows.where(F.col("action_id").isNull() & F.col("transaction_id").isNotNull()))
    return with_id.unionByName(without_id)


def corp_actions_without_key(batch: DataFrame) -> DataFrame:
    return batch.where(F.col("action_id").isNull() & F.col("transaction_id").isNull())


def _merge_identified_actions(rows: DataFrame) -> DataFrame:
    keys = ["account_id", "action_id"]
    last = ["reorg_code", "report_date_local", "requires_manual", "provisional"]
    known = ["instrument_id", "transaction_id", "description", "manual_case_id"]
    merged = rows.groupBy(*keys).agg(_first(_rest(rows, keys, last, known)), _last(last), *map(_last_known, known))
    return merged.select(*keys, "first.*", "last.*", *known)


def _merge_fallback_actions(rows: DataFrame) -> DataFrame:
    """A second source row for the same fallback key needs a person; replaying the same row does not."""
    keys = CORP_ACTION_FALLBACK_KEY
    flags = ["requires_manual", "provisional"]
    known = ["description", "manual_case_id"]
    repeated = _differs("source_raw_record_id")
    merged = rows.groupBy(*keys).agg(
        _first(_rest(rows, keys, flags, known)),
        *((repeated | F.coalesce(F.bool_or(flag), F.lit(False))).alias(flag) for flag in flags),
        _last_known("description"),
        _first_known("manual_case_id"),
    )
    return merged.select(*keys, "first.*", *flags, *known)


INSTRUMENT_REPLACED = ["symbol", "asset_category", "currency"]
INSTRUMENT_KEPT = ["local_symbol", "isin", "cusip", "figi", "description"]


def last_instrument_requests(batch: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Within a batch the last request of an instrument counts as a whole, nulls included."""
    keys = NATURAL_KEYS["instrument"]
    at = F.struct(*order)
    values = [*INSTRUMENT_REPLACED, *INSTRUMENT_KEPT]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*values), at).alias("last")).select(*keys, "last.*")


def merge_instruments(existing: DataFrame | None, batch: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Replace symbol, category and currency; other attributes only change to a known value."""
    keys = NATURAL_KEYS["instrument"]
    latest = last_instrument_requests(batch, order)
    if existing is None:
        return latest
    new, old = latest.alias("new"), existing.alias("old")
    joined = new.join(old, keys, "full_outer")
    present = F.col("new.symbol").isNotNull()
    replaced = [F.when(present, F.col(f"new.{n}")).otherwise(F.col(f"old.{n}")).alias(n) for n in INSTRUMENT_REPLACED]
    kept = [F.coalesce(f"new.{n}", f"old.{n}").alias(n) for n in INSTRUMENT_KEPT]
    return joined.select(*keys, *replaced, *kept)


def insert_new(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The batch rows to insert: the first of each key that is not stored yet."""
    first = F.min_by(F.struct(*(n for n in batch.columns if n not in keys)), F.struct(*order))
    firsts = batch.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.*")
    return firsts if existing is None else firsts.join(existing.select(*keys), list(keys), "left_anti")


def insert_counts(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Inserted and deduplicated row counts of an insert that ignores known keys."""
    per_key = batch.groupBy(*keys, *(n for n in by if n not in keys)).agg(F.count(F.lit(1)).alias("rows"))
    if existing is None:
        per_key = per_key.withColumn("stored", F.lit(False))
    else:
        marks = existing.select(*keys).distinct().withColumn("stored", F.lit(True))
        per_key = per_key.join(marks, list(keys), "left")
    new = F.when(F.coalesce("stored", F.lit(False)), 0).otherwise(1)
    inserted = F.coalesce(F.sum(new), F.lit(0)).alias("inserted_count")
    return per_key.groupBy(*by).agg(inserted, F.coalesce(F.sum(F.col("rows") - new), F.lit(0)).alias("deduplicated_count"))


def flag_deduplicated(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Add ``deduplicated``: false only for the row (smallest ``row_id``) that becomes the stored one.

    The first rows are found by aggregation and joined back on the unique ``row_id``, so a
    large group of copies is never in one task."""
    firsts = batch.groupBy(*keys).agg(F.min(row_id).alias(row_id))
    if existing is not None:
        firsts = firsts.join(existing.select(*keys), list(keys), "left_anti")
    marks = firsts.select(row_id, F.lit(False).alias("deduplicated"))
    return batch.join(marks, row_id, "left").withColumn("deduplicated", F.coalesce("deduplicated", F.lit(True)))


def merge_lots(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Lots by id: only what is left, closing time, realized amount and status change."""
    if existing is None:
        return batch
    mutable = ["remaining_quantity", "closed_at_utc", "realized_pnl_to_date", "status"]
    fixed = [n for n in batch.columns if n != "position_lot_id" and n not in mutable]
    joined = existing.alias("old").join(batch.alias("new"), "position_lot_id", "full_outer")
    present = F.col("new.status").isNotNull()
    return joined.select(
        "position_lot_id",
        *(F.when(F.col("old.status").isNotNull(), F.col(f"old.{n}")).otherwise(F.col(f"new.{n}")).alias(n) for n in fixed),
        *(F.when(present, F.col(f"new.{n}")).otherwise(F.col(f"old.{n}")).alias(n) for n in mutable),
    ).select(*batch.columns)


def merge_snapshots(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The new row of a (account, date, instrument) replaces the stored one."""
    if existing is None:
        return batch
    kept = existing.join(batch.select(*NATURAL_KEYS["pnl_snapshot_daily"]), NATURAL_KEYS["pnl_snapshot_daily"], "left_anti")
    return kept.unionByName(batch)
