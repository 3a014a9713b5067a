"""Ordered fallbacks for end-of-day marks and execution exchange rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import MONEY, RATE
from tallystone.operators.lookup import asof_by_date, lookup_join

MARK_OPEN_POSITION = "open_position_mark"
MARK_CLOSE_PRICE = "trade_close_price"
MARK_LAST_TRADE = "last_trade_price"
MARK_FALLBACK_CODE = "EOD_MARK_FALLBACK_LAST_TRADE"
MARK_MISSING_CODE = "EOD_MARK_MISSING_ALL_SOURCES"

FX_TRADE_RATE = "trade_fx_rate"
FX_NET_CASH = "net_cash_ratio"
FX_CONVERSION = "conversion_rate"
FX_BASE = "base_currency"
FX_MISSING_CODE = "FX_RATE_MISSING_ALL_SOURCES"

KEYS = ["account_id", "instrument_id"]
DAY = "report_date_local"


def eod_marks(targets: DataFrame, open_positions: DataFrame, trades: DataFrame) -> DataFrame:
    """Mark of each (account, instrument, report date) of ``targets``.

    1. mark of an open-position row of that date; 2. ``close_price`` of that date's latest
    trade; 3. price of the last trade on or before the date, provisional. All three inputs
    are first reduced to one row per instrument and day in one aggregate, so the running
    maximum sees days, however many trades an instrument has."""
    number = F.col("transaction_id").try_cast("decimal(38,0)")
    at = F.struct(F.col("trade_timestamp_utc").alias("at"), number.alias("number"), F.col("source_raw_record_id").alias("raw"))
    traded = trades.select(
        *KEYS,
        DAY,
        F.when(F.col("price").isNotNull(), F.struct(at.alias("at"), F.col("price").alias("price"))).alias("last_trade"),
        F.when(F.col("close_price").isNotNull(), F.struct(at.alias("at"), F.col("close_price").alias("price"))).alias("close"),
    )
    marked = open_positions.where(F.col("mark_price").isNotNull()).select(
        *KEYS, DAY, F.struct(F.col("raw_record_id").alias("raw"), F.col("mark_price").alias("price")).alias("mark")
    )
    asked = targets.select(*KEYS, DAY, F.lit(True).alias("asked"))
    rows = traded.unionByName(marked, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    best = [F.max(name).alias(name) for name in ("last_trade", "close", "mark", "asked")]
    so_far = Window.partitionBy(*KEYS).orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = rows.groupBy(*KEYS, DAY).agg(*best).withColumn("last_trade", F.max("last_trade").over(so_far)).where("asked")
    source = (
        F.when(F.col("mark").isNotNull(), MARK_OPEN_POSITION)
        .when(F.col("close").isNotNull(), MARK_CLOSE_PRICE)
        .when(F.col("last_trade").isNotNull(), MARK_LAST_TRADE)
    )
    return days.select(
        *KEYS,
        DAY,
        F.coalesce("mark.price", "close.price", "last_trade.price").cast(MONEY).alias("mark_price"),
        source.alias("mark_source"),
        (source.isNull() | (source == MARK_LAST_TRADE)).alias("provisional"),
        F.when(source.isNull(), MARK_MISSING_CODE).when(source == MARK_LAST_TRADE, MARK_FALLBACK_CODE).alias("diagnostic_code"),
    )


def daily_rates(rates: DataFrame) -> DataFrame:
    """One rate per (currency, base, date): latest run, then highest raw id."""
    return (
        rates.where(F.col("fx_rate").isNotNull())
        .groupBy("currency", "functional_currency", DAY)
        .agg(F.max_by("fx_rate", F.struct("ingestion_run_id", "source_raw_record_id")).alias("fx_rate"))
    )


def execution_fx(trades: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate to base of each trade with the source it came from.

    A pair such as EUR to USD may hold a third of all trades, so the nearest earlier rate
    is found on the (pair, date) grain and looked up from there."""
    pair = ["currency", "functional_currency"]
    asked = trades.select(*pair, DAY).distinct()
    found = asof_by_date(asked, daily_rates(rates), pair, DAY, ["fx_rate"])
    nearest = found.select(*pair, DAY, F.col("asof.fx_rate").alias("conversion_rate"), F.col(f"asof.{DAY}").alias("rate_date"))
    rows = lookup_join(trades, nearest, [*pair, DAY])
    ratio = F.bround(F.col("net_cash_in_base") / F.nullif(F.col("net_cash"), F.lit(0)), 10).cast(RATE)
    own = F.when(F.col("fx_rate_to_base") != 0, F.col("fx_rate_to_base")).cast(RATE)
    base = F.when(F.col("currency") == F.col("functional_currency"), F.lit(1).cast(RATE))
    source = (
        F.when(own.isNotNull(), FX_TRADE_RATE)
        .when(ratio.isNotNull(), FX_NET_CASH)
        .when(F.col("conversion_rate").isNotNull(), FX_CONVERSION)
        .when(base.isNotNull(), FX_BASE)
    )
    return rows.select(
        "account_id",
        "ib_exec_id",
        *pair,
        DAY,
        F.coalesce(own, ratio, F.col("conversion_rate").cast(RATE), base).alias("economic_fx_rate"),
        source.alias("fx_source"),
        F.when(source == FX_CONVERSION, F.col("rate_date")).alias("rate_date"),
        source.isNull().alias("provisional"),
        F.when(source.isNull(), FX_MISSING_CODE).alias("diagnostic_code"),
    )
