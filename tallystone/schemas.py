"""Explicit schemas of the stored tables (DDL). Instants are UTC ``timestamp_ntz``."""

from __future__ import annotations

from tallystone.functions.text import MONEY, RATE

RAW_ARTIFACT = (
    "raw_artifact_id string, ingestion_run_id string, account_id string, period_key string, flex_query_id string, "
    "payload_sha256 string, report_date_local date, source_payload binary, created_at_utc timestamp_ntz"
)
RAW_RECORD = (
    "raw_record_id string, raw_artifact_id string, ingestion_run_id string, account_id string, period_key string, "
    "flex_query_id string, report_date_local date, section_name string, source_row_ref string, "
    "statement_index int, row_index int, source_payload map<string,string>, created_at_utc timestamp_ntz"
)
INSTRUMENT = (
    "account_id string, conid string, symbol string, local_symbol string, isin string, cusip string, figi string, "
    "asset_category string, currency string, description string"
)
TRADE_FILL = (
    "account_id string, ib_exec_id string, instrument_id string, ingestion_run_id string, source_raw_record_id string, "
    "transaction_id string, trade_timestamp_utc timestamp_ntz, report_date_local date, side string, "
    f"quantity {MONEY}, price {MONEY}, cost {MONEY}, commission {MONEY}, fees {MONEY}, realized_pnl {MONEY}, "
    f"net_cash {MONEY}, net_cash_in_base {MONEY}, fx_rate_to_base {RATE}, currency string, functional_currency string"
)
CASHFLOW = (
    "account_id string, transaction_id string, cash_action string, currency string, instrument_id string, "
    "ingestion_run_id string, source_raw_record_id string, report_date_local date, effective_at_utc timestamp_ntz, "
    f"amount {MONEY}, amount_in_base {MONEY}, functional_currency string, withholding_tax {MONEY}, fees {MONEY}, "
    "is_correction boolean"
)
FX = (
    "account_id string, transaction_id string, currency string, functional_currency string, ingestion_run_id string, "
    f"source_raw_record_id string, report_date_local date, fx_rate {RATE}, fx_source string, provisional boolean, "
    "diagnostic_code string"
)
CORP_ACTION = (
    "account_id string, action_id string, transaction_id string, conid string, report_date_local date, reorg_code string, "
    "instrument_id string, ingestion_run_id string, source_raw_record_id string, description string, "
    "requires_manual boolean, provisional boolean, manual_case_id string"
)
POSITION_LOT = (
    "position_lot_id string, account_id string, instrument_id string, open_event_trade_fill_id string, direction string, "
    "opened_at_utc timestamp_ntz, closed_at_utc timestamp_ntz, "
    f"open_quantity {MONEY}, remaining_quantity {MONEY}, open_price {MONEY}, cost_basis_open {MONEY}, "
    f"realized_pnl_to_date {MONEY}, status string"
)
PNL_SNAPSHOT = (
    "account_id string, report_date_local date, instrument_id string, "
    f"position_qty {MONEY}, cost_basis {MONEY}, realized_pnl {MONEY}, unrealized_pnl {MONEY}, total_pnl {MONEY}, "
    f"fees {MONEY}, withholding_tax {MONEY}, currency string, provisional boolean, valuation_source string, "
    "fx_source string, ingestion_run_id string"
)
TABLES = {
    "raw_artifact": RAW_ARTIFACT,
    "raw_record": RAW_RECORD,
    "instrument": INSTRUMENT,
    "event_trade_fill": TRADE_FILL,
    "event_cashflow": CASHFLOW,
    "event_fx": FX,
    "event_corp_action": CORP_ACTION,
    "position_lot": POSITION_LOT,
    "pnl_snapshot_daily": PNL_SNAPSHOT,
}
NATURAL_KEYS = {
    "raw_artifact": ["account_id", "period_key", "flex_query_id", "payload_sha256"],
    "raw_record": ["raw_artifact_id", "section_name", "source_row_ref", "statement_index"],
    "instrument": ["account_id", "conid"],
    "event_trade_fill": ["account_id", "ib_exec_id"],
    "event_cashflow": ["account_id", "transaction_id", "cash_action", "currency"],
    "event_fx": ["account_id", "transaction_id", "currency", "functional_currency"],
    "position_lot": ["position_lot_id"],
    "pnl_snapshot_daily": ["account_id", "report_date_local", "instrument_id"],
}
