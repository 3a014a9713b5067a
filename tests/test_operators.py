from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallystone.operators import corporate, export, fallback, listing, mapping, quality, reports, runs, scan, snapshot
from tallystone.operators.lookup import lookup_join
from tallystone.session import scratch_path
from tallystone.sources import tables

FILL = (
    "account_id string, instrument_id string, trade_timestamp_utc timestamp_ntz, source_raw_record_id string, fill_id string, side string, "
    "quantity decimal(24,8), price decimal(24,8), fees decimal(24,8), report_date_local date, functional_currency string"
)


def one_fill(spark):
    at = F.lit("2026-02-14 10:00:00").cast("timestamp_ntz")
    row = [("U1", "7", None, "r", "f", "BUY", D(10), D(100), D(0), date(2026, 2, 14), "USD")]
    return spark.createDataFrame(row, FILL).withColumn("trade_timestamp_utc", at)


CASH = "account_id string, instrument_id string, report_date_local date, fees decimal(24,8), withholding_tax decimal(24,8)"
VALUE = "account_id string, instrument_id string, position_qty decimal(24,8), broker_unrealized_pnl decimal(24,8)"


@pytest.mark.parametrize(
    "broker, want",
    [
        ([], (True, snapshot.NO_BROKER_ROW, 0)),
        ([("U1", "7", D(10), D(200))], (False, snapshot.BROKER_VALUE, 200)),
        ([("U1", "7", D(11), D(200))], (True, snapshot.POSITION_MISMATCH, 0)),
    ],
)
def test_valuation_decision(spark, broker, want):
    cash = spark.createDataFrame([("U1", "7", date(2026, 2, 14), D(2), D(1)), ("U1", None, date(2026, 2, 14), D(9), None)], CASH)
    row = snapshot.build_snapshot(one_fill(spark), cash, spark.createDataFrame(broker, VALUE), "2026-02-14").first()
    assert (row.provisional, row.valuation_source, row.unrealized_pnl) == want
    assert (row.realized_pnl, row.fees, row.withholding_tax) == (-3, 2, 1)


@pytest.mark.parametrize("min_rows", [None, 3, 10])
def test_running_sums_do_not_depend_on_cuts(spark, min_rows):
    rows = spark.range(200).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 37 % 101).alias("o"), "id", (F.col("id") % 11).cast("decimal(18,8)").alias("v"))
    cuts = scan.split_points(rows, ["k"], ["o", "id"], min_rows=min_rows) if min_rows else None
    pieces = scan.with_pieces(rows, ["k"], scan.order_value(["o", "id"]), cuts)
    if cuts is not None:
        assert pieces.groupBy("k", "_piece").count().agg(F.max("count")).first()[0] <= 4 * max(min_rows, 3)
    got = scan.running_sums(pieces, ["k"], ["o", "id"], {"s": F.col("v")}, cuts, totals=True).orderBy("k", "o", "id").collect()
    plain = rows.collect()
    for r in got:
        mine = [x for x in plain if x.k == r.k]
        assert r.s == sum(x.v for x in mine if (x.o, x.id) <= (r.o, r.id)) and r.s_total == sum(x.v for x in mine)


def test_percentile_with_and_without_cuts(spark):
    values = [(i * 7919) % 1000 for i in range(150)]
    hist = spark.createDataFrame([("U1", date(2026, 1, 1), v, 1) for v in set(values)], "account_id string, run_date date, duration_ms bigint, n bigint")
    exact = hist.selectExpr("percentile(duration_ms, 0.95) p").first().p
    cuts = scan.split_points(hist, ["account_id", "run_date"], ["duration_ms"], min_rows=7)
    for c in (None, cuts):
        assert float(runs.duration_p95(hist, c).first().p95_ms) == pytest.approx(exact, abs=0.006)


def test_lookup_join_is_the_same_either_way(spark):
    facts = spark.range(50).select((F.col("id") % 4).alias("k"), "id")
    names = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    rows = [sorted(map(str, join.collect())) for join in (lookup_join(facts, names, ["k"]), facts.join(names, ["k"], "left"))]
    assert rows[0] == rows[1] and len(rows[0]) == 50


def test_listing_rejects_and_clamps(spark):
    runs_df = spark.range(300).selectExpr("cast(id as string) ingestion_run_id", "timestamp_ntz'2026-01-01' started_at_utc", "'success' status", "'manual' run_type", "id duration_ms", "cast(null as timestamp_ntz) ended_at_utc")
    page = listing.list_runs(runs_df, "duration_ms", "desc", limit=500, offset=150).envelope()
    assert page["page"] == {"limit": 500, "applied_limit": 200, "offset": 150, "returned": 150, "total": 300, "has_more": False}
    assert page["items"][0]["duration_ms"] == 149 and page["sort"] == {"sort_by": "duration_ms", "sort_dir": "desc"}
    for arguments, code in ((("name", "asc"), "INVALID_SORT_FIELD"), (("status", "up"), "INVALID_SORT_DIRECTION"), (("status", "asc", 0), "INVALID_PAGINATION"), (("status", "asc", 1, -1), "INVALID_PAGINATION")):
        with pytest.raises(listing.ListingError) as error:
            listing.list_runs(runs_df, *arguments)
        assert error.value.code == code


def test_tolerance_edges(spark):
    keys = "account_id string, report_date_local date, instrument_id string"
    economic = spark.createDataFrame(
        [("U1", date(2026, 1, 1), i, D(100) + D(d), D(1), c, False) for i, d, c in (("a", "0.01", "USD"), ("b", "0.0100001", "USD"), ("c", "0.02", "USD"), ("d", "1", "JPY"), ("e", "1.01", "JPY"))],
        f"{keys}, fees decimal(24,8), position_qty decimal(24,8), currency string, provisional boolean",
    )
    broker = economic.selectExpr("account_id", "report_date_local", "instrument_id", "cast(100 as decimal(24,8)) fees", "cast('1.000001' as decimal(24,8)) position_qty")
    got = {(r.instrument_id, r.metric): r.within_tolerance for r in reports.reconciliation_diff(economic, broker, ("fees", "position_qty")).collect()}
    # at 100 the relative tolerance also allows 0.01
    assert [got[i, "fees"] for i in "abcde"] == [True, False, False, True, False] and got["a", "position_qty"] is True


def test_eod_mark_order(spark):
    trades = spark.createDataFrame(
        [("U1", "7", date(2026, 1, 2), "9", "r1", D(10), D(11)), ("U1", "7", date(2026, 1, 2), "10", "r2", D(12), D(13)), ("U1", "7", date(2026, 1, 3), "1", "r3", D(20), None)],
        "account_id string, instrument_id string, report_date_local date, transaction_id string, source_raw_record_id string, price decimal(24,8), close_price decimal(24,8)",
    ).withColumn("trade_timestamp_utc", F.lit("2026-01-02").cast("timestamp_ntz"))
    positions = spark.createDataFrame([("U1", "7", date(2026, 1, 5), D(50), "p")], "account_id string, instrument_id string, report_date_local date, mark_price decimal(24,8), raw_record_id string")
    days = [date(2026, 1, d) for d in (1, 2, 3, 4, 5)]
    asked = spark.createDataFrame([("U1", "7", d) for d in days], "account_id string, instrument_id string, report_date_local date")
    got = [(r.mark_price, r.diagnostic_code) for r in fallback.eod_marks(asked, positions, trades).orderBy("report_date_local").collect()]
    # equal times: the highest numeric transaction id wins, on every later day too
    assert got == [(None, fallback.MARK_MISSING_CODE), (13, None), (12, fallback.MARK_FALLBACK_CODE), (12, fallback.MARK_FALLBACK_CODE), (50, None)]


def test_export_contract(spark):
    rows = spark.createDataFrame([(date(2026, 1, 1), "i", "c", "S", "USD", D(1), None, D(0), D(0), D(0), True)], ", ".join(f"{f.name} {f.kind}" for f in export.BY_INSTRUMENT))
    path = scratch_path(spark, "csv")
    export.write_csv(rows, export.BY_INSTRUMENT, path)
    line = spark.read.option("header", True).csv(f"{path}/v1").first()
    assert line.position_qty == "1.00000000" and line.realized_pnl == "0.00000000" and line.cost_basis is None
    with pytest.raises(export.ExportContractError):
        export.check_columns(rows.select(*reversed(rows.columns)), export.BY_INSTRUMENT)
    with pytest.raises(export.ExportContractError):
        export.write_csv(rows.withColumn("symbol", F.lit(None).cast("string")), export.BY_INSTRUMENT, path)


def test_archive_and_run_states(spark):
    events = spark.createDataFrame([("r1", "started", "2026-01-01 00:00:00"), ("r1", "success", "2026-01-01 00:00:02.0006"), ("r2", "started", "2026-03-20 00:00:00")], "run_id string, status string, at string")
    events = events.select("run_id", "status", F.col("at").cast("timestamp_ntz").alias("at_utc"))
    got = {r.run_id: (r.status, r.duration_ms) for r in runs.current_runs(events).collect()}
    assert got == {"r1": ("success", 2001), "r2": ("started", None)}
    split = runs.split_by_retention(events, "2026-04-01")
    path = scratch_path(spark, "archive")
    runs_old = split.where("retention_class = 'archive'").drop("retention_class")
    export.write_archive(runs_old, path)
    assert spark.read.json(path).count() == 2


def test_quality_rules(spark):
    lots = spark.createDataFrame([("x", "open", D(1)), (None, "gone", D(-1))], "position_lot_id string, status string, remaining_quantity decimal(24,8)")
    found = {r.rule: r.violation_count for r in quality.row_rules(lots, "position_lot", quality.table_rules()["position_lot"]).collect()}
    assert found == {"status_allowed": 1, "remaining_quantity_not_negative": 1, "position_lot_id_is_uuid": 2}
    keys = spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int")
    assert quality.unique_rule(keys, "t", ["k"]).first().violation_count == 1
    assert quality.reference_rule(keys, "t", "k", spark.range(1), "id").first().violation_count == 2


def test_runs_by_state_and_id(spark):
    at = "timestamp_ntz'2026-01-01 10:00:00'"
    started = spark.sql(f"SELECT 'r2' run_id, 'U1' account_id, {at} at_utc")
    events = spark.sql(f"SELECT 'r1' run_id, 'U1' account_id, {at} at_utc, 'started' status UNION ALL SELECT 'r1', 'U1', {at} + INTERVAL 2 SECONDS, 'success'")
    states = runs.current_runs(runs.open_runs(events, started))
    assert {(r.run_id, r.status, r.duration_ms) for r in states.collect()} == {("r1", "success", 2000), ("r2", "started", None)}
    assert tables.active_run(states, "U1").first().run_id == "r2" and tables.active_run(states, "U2").isEmpty()
    assert tables.run_by_id(states, "r1").first().status == "success"


def test_date_and_reference_rules(spark):
    rows = spark.createDataFrame([("2026-01-31",), ("2026-02-30",), ("31.1.2026",), (None,)], "day string")
    assert quality.row_rules(rows, "t", [quality.is_iso_date("day")]).first().violation_count == 3
    trades = spark.createDataFrame([("U1", "1"), ("U1", "2"), ("U1", None)], "account_id string, conid string")
    known = spark.createDataFrame([("U1", "1")], "account_id string, conid string")
    linked = mapping.with_instrument(trades, known)
    assert {r.conid for r in mapping.unresolved_trades(linked).collect()} == {"2", None} and linked.count() == 3


def test_only_listed_corporate_actions_go_without_a_person(spark):
    rows = spark.createDataFrame([(c, False, False) for c in ("FS", "rs ", "SD", "CD", "FI", "CP", "IC", "SO", None)], "reorg_code string, requires_manual boolean, provisional boolean")
    clear = corporate.classify(rows, F.lit(True))
    assert {r.reorg_code for r in clear.where(~F.col("requires_manual")).collect()} == {"FS", "rs ", "SD", "CD"}
    assert corporate.classify(rows).where(~F.col("requires_manual")).isEmpty()


def test_keys_of_a_table_in_one_pass_equal_them_one_by_one(spark):
    rows = [(1, "a", None), (1, "a", 5), (1, None, 5), (None, "a", 5), (2, "b", 6), (2, "b", 6), (1, "a", 5)]
    df = spark.createDataFrame(rows, "k int, n string, v int")
    keys = [["k", "n"], ["v"], ["k", "v"], ["n", "k", "v"]]
    one_by_one = quality.combined(*(quality.unique_rule(df, "t", key) for key in keys))
    assert sorted(map(tuple, quality.unique_rules(df, "t", keys).collect())) == sorted(map(tuple, one_by_one.collect()))
    empty = quality.unique_rules(df.limit(0), "t", keys).collect()
    assert sorted((r.rule, r.violation_count) for r in empty) == sorted(("unique_" + "_".join(key), 0) for key in keys)
