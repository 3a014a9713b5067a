"""Filtered, column-pruned scans of stored tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions.dates import mixed_date
from tallystone.functions.text import decimal_value

VALUATION_KEYS = ("position", "markPrice", "fifoPnlUnrealized")


def raw_rows_of_run(raw: DataFrame, ingestion_run_id: str) -> DataFrame:
    return raw.where(F.col("ingestion_run_id") == ingestion_run_id)


def raw_rows_of_period(raw: DataFrame, account_id: str, period_key: str, flex_query_id: str) -> DataFrame:
    """Raw rows to replay; the raw table is partitioned by ``period_key``."""
    return raw.where(
        (F.col("period_key") == period_key) & (F.col("account_id") == account_id) & (F.col("flex_query_id") == flex_query_id)
    )


def _for_account(df: DataFrame, account_id: str | None, through: date | str | None) -> DataFrame:
    if account_id is not None:
        df = df.where(F.col("account_id") == account_id)
    if through is not None:
        df = df.where(F.col("report_date_local") <= F.lit(through).cast("date"))
    return df


def fills(trades: DataFrame, account_id: str | None = None, through: date | str | None = None) -> DataFrame:
    """Fills for the lot matcher up to a report date, inclusive; all accounts when none is named."""
    wanted = [
        "account_id", "instrument_id", "ib_exec_id", "source_raw_record_id", "trade_timestamp_utc", "report_date_local",
        "side", "quantity", "price", "fees", "commission", "currency", "functional_currency",
    ]
    return _for_account(trades, account_id, through).select(*wanted)


def cashflows(table: DataFrame, account_id: str | None = None, through: date | str | None = None) -> DataFrame:
    wanted = ["account_id", "instrument_id", "report_date_local", "source_raw_record_id", "fees", "withholding_tax"]
    return _for_account(table, account_id, through).select(*wanted)


def open_positions(raw: DataFrame, instruments: DataFrame) -> DataFrame:
    """Broker valuations per instrument: the raw row with the highest id.

    ``raw`` holds the raw rows of the run; ``instruments`` maps (account_id, conid) to
    instrument_id. Numbers are read like all others (separators stripped, null when bad)."""
    payload = lambda key: F.try_element_at("source_payload", F.lit(key))
    wanted = raw.where(
        (F.col("section_name") == "OpenPositions")
        & (F.coalesce(payload("assetCategory"), F.lit("")) == "STK")
        & F.map_contains_key("source_payload", "position")
        & F.map_contains_key("source_payload", "markPrice")
        & F.map_contains_key("source_payload", "fifoPnlUnrealized")
    ).select(
        "account_id",
        payload("conid").alias("conid"),
        "raw_record_id",
        decimal_value(payload("position")).alias("position_qty"),
        decimal_value(payload("markPrice")).alias("mark_price"),
        decimal_value(payload("fifoPnlUnrealized")).alias("broker_unrealized_pnl"),
        mixed_date(payload("reportDate")).alias("report_date_local"),
    )
    known = instruments.select("account_id", "conid", "instrument_id")
    values = F.struct("position_qty", "mark_price", "broker_unrealized_pnl", "report_date_local", "raw_record_id")
    latest = wanted.groupBy("account_id", "conid").agg(F.max_by(values, "raw_record_id").alias("v"))
    return latest.join(known, ["account_id", "conid"]).select("account_id", "instrument_id", "v.*")


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def active_run(runs: DataFrame, account_id: str) -> DataFrame:
    return runs.where((F.col("account_id") == account_id) & (F.col("status") == "started")).limit(1)
