from __future__ import annotations

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallystone.operators import fifo

SCHEMA = (
    "account_id string, instrument_id string, trade_timestamp_utc string, source_raw_record_id string, fill_id string, side string, "
    "quantity decimal(24,8), price decimal(24,8), fees decimal(24,8)"
)


def frame(spark, rows):
    """rows: (instrument, day, id, side, quantity, price, fee)"""
    data = [("U1", i, f"2026-01-{d:02d} 10:00:00", r, r, s, D(q), D(p), D(f)) for i, d, r, s, q, p, f in rows]
    return spark.createDataFrame(data, SCHEMA).withColumn("trade_timestamp_utc", F.col("trade_timestamp_utc").cast("timestamp_ntz"))


def twin(rows):
    """The rules as a plain loop: instrument -> (position, realized, open lots)."""
    out = {}
    for instrument in {r[0] for r in rows}:
        lots, realized = [], D(0)
        for _, _, rid, side, q, p, f in sorted((r for r in rows if r[0] == instrument), key=lambda r: (r[1], r[2])):
            q, p, f = abs(D(q)), D(p), D(f)
            sign, left = (1 if side == "BUY" else -1), q
            while left > 0 and lots and lots[0]["sign"] == -sign:
                lot = lots[0]
                m = min(left, lot["left"])
                gain = (p - lot["basis"]) * m * lot["sign"]
                realized += gain - f / q * m
                lot["left"], lot["gain"], left = lot["left"] - m, lot["gain"] + gain, left - m
                if lot["left"] == 0:
                    lots.pop(0)
            if left > 0:
                lots.append({"id": rid, "sign": sign, "basis": p + sign * f / q, "left": left, "gain": D(0)})
        out[instrument] = (sum(x["left"] * x["sign"] for x in lots), realized, lots)
    return out


CASES = {
    "partial close with fees": ([("i", 1, "f1", "BUY", 10, 100, 1), ("i", 2, "f2", "SELL", 4, 120, 1)], 130, 6, "78.6", "179.4"),
    "zero quantity": ([("i", 1, "f1", "BUY", 10, 100, 0), ("i", 2, "f2", "BUY", 0, 999, 0), ("i", 3, "f3", "SELL", 4, 120, 0)], 110, 6, "80", "60"),
    "signed sell": ([("i", 1, "f1", "BUY", 10, 100, 0), ("i", 2, "f2", "SELL", -4, 120, 0)], 130, 6, "80", "180"),
    "short": ([("i", 1, "f1", "SELL", -5, 100, 0), ("i", 2, "f2", "BUY", 2, 90, 0)], 80, -3, "20", "60"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_value_table(spark, name):
    rows, mark, position, realized, unrealized = CASES[name]
    fills = frame(spark, rows)
    assert fifo.realized_by_instrument(fills).first().realized_pnl == D(realized)
    marks = fills.select("account_id", "instrument_id").distinct().withColumn("mark_price", F.lit(mark).cast("decimal(24,8)"))
    row = fifo.unrealized_at_mark(fills, marks).first()
    assert (row.position_qty, row.unrealized_pnl) == (D(position), D(unrealized))


def test_short_lot_and_cost_basis(spark):
    rows, *_ = CASES["short"]
    lot = fifo.open_lots(frame(spark, rows)).first()
    assert (lot.direction, lot.open_quantity, lot.remaining_quantity, lot.cost_basis_open) == ("short", D(5), D(3), D(-500))
    held = fifo.instrument_summary(frame(spark, rows)).first()
    assert held.cost_basis == 0 and held.open_lot_count == 1  # only longs have a cost; null only without lots


def test_unknown_side_fails(spark):
    with pytest.raises(Exception, match="unsupported trade side"):
        fifo.realized_by_instrument(frame(spark, [("i", 1, "f1", "HOLD", 1, 1, 0)])).collect()


def random_rows(seed, count):
    rng = random.Random(seed)
    # one instrument holds most rows; fees are multiples of the quantity so that fees per unit are exact
    rows = []
    for n in range(count):
        q = rng.randint(1, 9)
        rows.append(("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randint(1, 28), f"f{n:04d}", rng.choice(["BUY", "SELL"]), q, rng.randint(50, 150), q * rng.randint(0, 3)))
    return rows


@pytest.mark.parametrize("hot_rows", [None, 5, 40])
def test_random_fills_match_the_loop(spark, hot_rows):
    rows = random_rows(7, 300)
    random.Random(1).shuffle(rows)
    fills = frame(spark, rows)
    cuts = fifo.fifo_cuts(fills, min_rows=hot_rows) if hot_rows else None
    assert (cuts is None) == (hot_rows is None)
    want = twin(rows)
    got = {r.instrument_id: r for r in fifo.instrument_summary(fills, cuts).collect()}
    lots = fifo.position_lots(fills, cuts).where("status = 'open'").collect()
    for instrument, (position, realized, open_lots) in want.items():
        assert got[instrument].position_qty == position and got[instrument].fifo_realized == realized
        mine = {r.open_event_trade_fill_id: (r.remaining_quantity, r.realized_pnl_to_date) for r in lots if r.instrument_id == instrument}
        assert mine == {x["id"]: (x["left"], x["gain"]) for x in open_lots}
    total = fifo.lot_matches(fills, cuts).groupBy("instrument_id").agg(F.sum("matched_quantity").alias("m")).collect()
    closed = {i: sum(abs(D(r[4])) for r in rows if r[0] == i) for i in want}
    for row in total:  # every closed unit was opened: opened + closed units = all units
        opened_left = abs(want[row.instrument_id][0])
        assert 2 * row.m + opened_left == closed[row.instrument_id]


def test_fees_that_do_not_divide(spark):
    rows = [("i", 1, "f1", "BUY", 3, 100, 1), ("i", 2, "f2", "SELL", 1, 100, 0), ("i", 3, "f3", "SELL", 2, 100, 0)]
    assert fifo.realized_by_instrument(frame(spark, rows)).first().realized_pnl == D(-1)


@pytest.mark.parametrize(
    "rows, realized",
    [
        ([("i", 1, "f1", "BUY", 3_000_000, 1, 1), ("i", 2, "f2", "SELL", 2_000_000, 1, 0)], "-0.66666667"),
        ([("i", 1, "f1", "BUY", "0.00000003", 1, "0.5"), ("i", 2, "f2", "SELL", "0.00000001", 1, 0)], "-0.16666667"),
        ([("i", 1, "f1", "BUY", 20_000_000_000, "0.5", 3), ("i", 2, "f2", "SELL", 10_000_000_000, "0.75", 0)], "2499999998.5"),
        ([("i", 1, "f1", "BUY", 2, "20000000000.25", 0), ("i", 2, "f2", "SELL", 2, "20000000000.5", 0)], "0.5"),
        ([("i", 1, "f1", "BUY", "12345678901.00000001", "1.00000001", 0), ("i", 2, "f2", "SELL", "12345678901.00000001", "1.00000002", 0)], "123.45678901"),
    ],
)
def test_uneven_fees_and_large_amounts(spark, rows, realized):
    fills = frame(spark, rows)
    assert fifo.realized_by_instrument(fills).first().realized_pnl == D(realized)
    lots = fifo.position_lots(fills).first()
    assert fifo.lot_matches(fills).first().match_pnl == lots.realized_pnl_to_date == D(realized)


def test_summary_sorts_its_fills_once(spark):
    """Running sums and totals share two windows, and the sums per key use their order; sides and quantities aren't shuffled."""
    plan = fifo.instrument_summary(frame(spark, [("i", 1, "f1", "BUY", 1, 1, 0)])).drop("net_cost")._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" +-:") for line in plan.split("\n")]
    assert sum(line.startswith("Window [") for line in lines) == 2
    assert sum(line.startswith("Sort [") for line in lines) == 1
