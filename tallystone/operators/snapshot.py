"""Daily position and profit snapshots per (account, instrument)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.text import MONEY
from tallystone.operators import fifo
from tallystone.operators.fifo import AMOUNT, KEYS

# How a snapshot row was valued.
NO_POSITION = "solid_no_open_position"
NO_BROKER_ROW = "missing_solid_broker_openpositions"
POSITION_MISMATCH = "missing_solid_position_mismatch"
BROKER_VALUE = "openpositions_fifo_unrealized"
FX_SOURCE = "event_fx_fallback"


def _or_zero(name: str, kind: str = MONEY) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(kind)


def cash_totals(cashflows: DataFrame) -> DataFrame:
    """Fees and withholding per instrument; cash rows without an instrument do not count."""
    return (
        cashflows.where(F.col("instrument_id").isNotNull())
        .groupBy(*KEYS)
        .agg(
            F.sum(_or_zero("fees")).cast(MONEY).alias("cash_fees"),
            F.sum(_or_zero("withholding_tax")).cast(MONEY).alias("withholding_tax"),
        )
    )


def trade_fee_totals(fills: DataFrame) -> DataFrame:
    return fills.groupBy(*KEYS).agg(F.sum(_or_zero("fees")).cast(MONEY).alias("trade_fees"))


def valuation_source(position: Column, broker_position: Column) -> Column:
    return (
        F.when(position == 0, NO_POSITION)
        .when(broker_position.isNull(), NO_BROKER_ROW)
        .when(broker_position != position, POSITION_MISMATCH)
        .otherwise(BROKER_VALUE)
    )


def build_snapshot(
    fills: DataFrame,
    cashflows: DataFrame,
    valuations: DataFrame,
    report_date: date | str,
    ingestion_run_id: str | None = None,
    cuts: DataFrame | None = None,
) -> DataFrame:
    """One row per account and instrument that ever traded up to the report date.

    ``fills`` as for the lot matcher plus ``functional_currency``; ``valuations`` holds one
    broker row per instrument (``position_qty``, ``broker_unrealized_pnl``)."""
    day = F.lit(report_date).cast("date")
    fills = fills.where(F.col("report_date_local") <= day)
    held = fifo.instrument_summary(fills, cuts)
    cash = cash_totals(cashflows.where(F.col("report_date_local") <= day))
    return valued(held.withColumn("report_date_local", day), cash, valuations, ingestion_run_id)


def valued(held: DataFrame, cash: DataFrame, valuations: DataFrame, ingestion_run_id: str | None, by_date: bool = False) -> DataFrame:
    """Snapshot rows of what is held on report dates. Cash totals are joined by key, and by date where they have
    one; broker rows by key, and with ``by_date`` by their report date."""
    day = ["report_date_local"]
    cash_keys, broker_keys = [*KEYS, *(day if "report_date_local" in cash.columns else [])], [*KEYS, *(day if by_date else [])]
    broker = valuations.select(*broker_keys, F.col("position_qty").alias("broker_qty"), "broker_unrealized_pnl")
    joined = held.join(cash, cash_keys, "left").join(broker, broker_keys, "left")
    source = valuation_source(F.col("position_qty"), F.col("broker_qty"))
    realized = F.col("fifo_realized") - _or_zero("cash_fees", AMOUNT) - _or_zero("withholding_tax", AMOUNT)
    rows = joined.select(
        *KEYS,
        "report_date_local",
        "position_qty",
        "cost_basis",
        realized.cast(MONEY).alias("realized_pnl"),
        F.when(source == BROKER_VALUE, F.col("broker_unrealized_pnl")).otherwise(0).cast(MONEY).alias("unrealized_pnl"),
        (F.col("trade_fees") + _or_zero("cash_fees", AMOUNT)).cast(MONEY).alias("fees"),
        _or_zero("withholding_tax").alias("withholding_tax"),
        F.col("functional_currency").alias("currency"),
        source.isin(NO_BROKER_ROW, POSITION_MISMATCH).alias("provisional"),
        source.alias("valuation_source"),
        F.lit(FX_SOURCE).alias("fx_source"),
        F.lit(ingestion_run_id).cast("string").alias("ingestion_run_id"),
    )
    return rows.select(
        "account_id", "report_date_local", "instrument_id", "position_qty", "cost_basis", "realized_pnl", "unrealized_pnl",
        (F.col("realized_pnl") + F.col("unrealized_pnl")).cast(MONEY).alias("total_pnl"),
        "fees", "withholding_tax", "currency", "provisional", "valuation_source", "fx_source", "ingestion_run_id",
    )


def snapshot_counters(snapshot: DataFrame, lots: DataFrame) -> DataFrame:
    """Snapshot rows, open lots and rows without a solid valuation, per account."""
    rows = snapshot.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("snapshot_row_count"), F.count_if("provisional").alias("missing_solid_valuation_count")
    )
    lot_rows = lots.where(F.col("status") == "open").groupBy("account_id").agg(F.count(F.lit(1)).alias("position_lot_row_count"))
    return rows.join(lot_rows, "account_id", "left").select(
        "account_id",
        "snapshot_row_count",
        F.coalesce("position_lot_row_count", F.lit(0).cast("bigint")).alias("position_lot_row_count"),
        "missing_solid_valuation_count",
    )
