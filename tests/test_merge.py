from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D

from tallystone import schemas
from tallystone.operators import merge

AT = [datetime(2026, 1, d) for d in range(1, 10)]


def trades(spark, *rows):
    base = {n: None for n in (f.split()[0] for f in schemas.TRADE_FILL.split(", "))}
    data = [tuple({**base, "account_id": "U1", **r}.values()) + (at,) for r, at in rows]
    return spark.createDataFrame(data, schemas.TRADE_FILL + ", created_at_utc timestamp_ntz")


def test_trade_keeps_first_but_takes_last_amounts(spark):
    one = trades(spark, ({"ib_exec_id": "e", "ingestion_run_id": "r1", "source_raw_record_id": "a", "commission": D(1), "fees": D(5), "cost": D(9)}, AT[0]))
    two = trades(spark, ({"ib_exec_id": "e", "ingestion_run_id": "r2", "source_raw_record_id": "b", "commission": D("2.5"), "fees": D(6)}, AT[1]))
    row = merge.merge_trades(merge.merge_trades(None, one), two).first()
    assert (row.ingestion_run_id, row.commission, row.fees, row.cost) == ("r1", D("2.5"), D(5), None)
    both = merge.merge_trades(None, one.unionByName(two)).first()
    assert both.asDict() == row.asDict()
    again = merge.merge_trades(merge.merge_trades(merge.merge_trades(None, one), two), two).first()
    assert again.asDict() == row.asDict()


def cash(spark, *rows):
    schema = schemas.CASHFLOW.replace(", is_correction boolean", "") + ", created_at_utc timestamp_ntz"
    base = {n: None for n in (f.split()[0] for f in schema.split(", "))}
    data = [tuple({**base, "account_id": "U1", "transaction_id": "t", "cash_action": "DIV", "currency": "USD", "report_date_local": date(2026, 1, 1), **r, "created_at_utc": at}.values()) for r, at in rows]
    return spark.createDataFrame(data, schema)


def test_cashflow_correction_is_sticky_and_keeps_instrument(spark):
    first = cash(spark, ({"amount": D(1), "instrument_id": "i", "source_raw_record_id": "a"}, AT[0]))
    same = merge.merge_cashflows(merge.merge_cashflows(None, first), cash(spark, ({"amount": D(1), "source_raw_record_id": "b"}, AT[1])))
    assert same.first().is_correction is False and same.first().instrument_id == "i"
    changed = merge.merge_cashflows(same, cash(spark, ({"amount": D(2), "source_raw_record_id": "c"}, AT[2])))
    row = changed.first()
    assert (row.is_correction, row.amount, row.instrument_id, row.source_raw_record_id) == (True, D(2), "i", "c")
    back = merge.merge_cashflows(changed, cash(spark, ({"amount": D(2), "source_raw_record_id": "d"}, AT[3])))
    assert back.first().is_correction is True


def test_raw_rows_are_inserted_once(spark):
    rows = spark.createDataFrame([("a", "s", "r1", 1), ("a", "s", "r2", 2)], "raw_artifact_id string, section_name string, source_row_ref string, n int")
    keys = ["raw_artifact_id", "section_name", "source_row_ref"]
    assert merge.insert_counts(None, rows, keys).first().asDict() == {"inserted_count": 2, "deduplicated_count": 0}
    stored = merge.insert_new(None, rows, keys, ["n"])
    assert merge.insert_counts(stored, rows, keys).first().asDict() == {"inserted_count": 0, "deduplicated_count": 2}
    assert merge.insert_new(stored, rows, keys, ["n"]).count() == 0


def action(spark, *rows):
    schema = schemas.CORP_ACTION + ", created_at_utc timestamp_ntz"
    base = {n: None for n in (f.split()[0] for f in schema.split(", "))}
    base |= {"account_id": "U1", "conid": "7", "report_date_local": date(2026, 1, 1), "reorg_code": "FS", "requires_manual": False, "provisional": False}
    return spark.createDataFrame([tuple({**base, **r, "created_at_utc": at}.values()) for r, at in rows], schema)


def test_fallback_key_repeats_need_a_person(spark):
    one = action(spark, ({"transaction_id": "t", "source_raw_record_id": "a"}, AT[0]))
    stored = merge.merge_corp_actions(None, one)
    assert stored.first().requires_manual is False
    assert merge.merge_corp_actions(stored, one).first().requires_manual is False  # the same row again
    again = merge.merge_corp_actions(stored, action(spark, ({"transaction_id": "t", "source_raw_record_id": "b", "description": "d"}, AT[1]))).first()
    assert (again.requires_manual, again.provisional, again.description, again.source_raw_record_id) == (True, True, "d", "a")
    nothing = action(spark, ({"source_raw_record_id": "a"}, AT[0]))
    assert merge.merge_corp_actions(None, nothing).count() == 0 and merge.corp_actions_without_key(nothing).count() == 1


def test_instruments_keep_known_attributes(spark):
    schema = schemas.INSTRUMENT + ", created_at_utc timestamp_ntz, source_raw_record_id string"
    row = lambda symbol, isin, at: ("U1", "7", symbol, None, isin, None, None, "STK", "USD", None, at, "x")
    old = merge.merge_instruments(None, spark.createDataFrame([row("A", "I1", AT[0])], schema))
    batch = spark.createDataFrame([row("B", "I2", AT[1]), row("C", None, AT[2])], schema)
    got = merge.merge_instruments(old, batch).first()
    assert (got.symbol, got.isin) == ("C", "I1")  # within a batch the last row counts as a whole


def test_lots_and_snapshots(spark):
    lots = spark.createDataFrame([("l1", D(5), "open", "x"), ("l2", D(1), "open", "x")], "position_lot_id string, remaining_quantity decimal(24,8), status string, account_id string")
    full = lots.selectExpr("*", "cast(null as timestamp_ntz) closed_at_utc", "cast(0 as decimal(24,8)) realized_pnl_to_date")
    new = full.where("position_lot_id = 'l1'").selectExpr("position_lot_id", "cast(0 as decimal(24,8)) remaining_quantity", "'closed' status", "'y' account_id", "timestamp_ntz'2026-01-02' closed_at_utc", "realized_pnl_to_date")
    got = {r.position_lot_id: (r.status, r.account_id) for r in merge.merge_lots(full, new).collect()}
    assert got == {"l1": ("closed", "x"), "l2": ("open", "x")}
