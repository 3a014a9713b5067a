"""First-in-first-out lot matching as running sums and interval overlap.

Lots of one (account, instrument) never have both directions open at once, so the
signed running position tells how much of a fill closes and how much opens. All opened
units of a direction lie on one axis in the order they were opened, all closed units on
the same axis in the order they were closed, and a unit closed at a place was opened at
the same place.

* Realized profit, position, open lots and their cost need no matching at all: the open
  units are the last ones on the axis, everything before is consumed. One pass of
  running sums is enough (``fill_usage``).
* Who closed whom (``lot_matches``) merges the ends of the opening and closing intervals.

Amounts: quantities, prices and fees are ``decimal(24,8)`` as the tables hold them. The fee
that falls on a part of a fill is fee times part over quantity, divided once per use with 16
places kept; amounts have 16 places and 20 digits before the point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.ids import lot_id
from tallystone.functions.text import MONEY, normalized_side
from tallystone.operators.scan import (
    PIECE,
    QUANTITY_SUM,
    hot_rows,
    in_blocks,
    order_value,
    piece_keys,
    running_sums,
    split_points,
    with_pieces,
)

KEYS = ["account_id", "instrument_id"]
ORDER = ["trade_timestamp_utc", "source_raw_record_id"]
AXIS = [*KEYS, "direction"]

UNIT = MONEY
AMOUNT = "decimal(38,16)"
_PART = "decimal(36,16)"  # parts of a product, so that their sum keeps its places


def trade_fee(fees: Column, commission: Column) -> Column:
    """Combined trade fee, sign as delivered."""
    zero = F.lit(0).cast(MONEY)
    return (F.coalesce(fees, zero) + F.coalesce(commission, zero)).cast(MONEY)


def _zero(kind: str = QUANTITY_SUM) -> Column:
    return F.lit(0).cast(kind)


def _signed(side: Column, quantity: Column) -> Column:
    unknown = F.raise_error(F.concat(F.lit("unsupported trade side="), F.coalesce(side, F.lit("null"))))
    return F.when(side == "BUY", quantity).when(side == "SELL", -quantity).otherwise(unknown.cast(UNIT))


def _currency(df: DataFrame) -> list[str]:
    """The functional currency, where the fills have one."""
    return [name for name in ("functional_currency",) if name in df.columns]


def prepared_fills(fills: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Fills with positive quantity, one signed quantity and one fee.

    Needs KEYS, ORDER, ``fill_id``, ``side``, ``quantity``, ``price``, ``fees`` and, when
    present, ``withholding_tax`` and ``fee_quantity``, the units that the fees were paid for
    (the rest of a partly closed lot keeps those of the whole). The sign of a quantity is ignored; a fill of zero
    quantity opens and closes nothing and its side is not looked at. Columns to ``carry`` stay as they are."""
    tax = F.coalesce(F.col("withholding_tax"), _zero(MONEY)) if "withholding_tax" in fills.columns else _zero(MONEY)
    paid_for = F.coalesce("fee_quantity", "quantity") if "fee_quantity" in fills.columns else F.col("quantity")
    base = fills.select(
        *KEYS,
        *ORDER,
        "fill_id",
        F.abs(paid_for).cast(UNIT).alias("fee_quantity"),
        normalized_side(F.col("side")).alias("side"),
        F.abs("quantity").cast(UNIT).alias("quantity"),
        F.col("price").cast(UNIT).alias("price"),
        (F.coalesce(F.col("fees"), _zero(MONEY)) + tax).cast(UNIT).alias("fee"),
        *_currency(fills),
        *carry,
    )
    traded = F.col("quantity") != 0
    return base.withColumn("signed", F.when(traded, _signed(F.col("side"), F.col("quantity"))).otherwise(_zero(UNIT)))


def fifo_cuts(profile: DataFrame, counts: DataFrame | None = None, **limits: int) -> DataFrame | None:
    """Cuts of hot (account, instrument) keys; see ``scan.split_points``."""
    return split_points(profile, KEYS, ORDER, counts=counts, **limits)


def _amount(price: str | Column, quantity: Column) -> Column:
    """Exact product. Spark would round the product of two wide decimals to six places, so
    factors of 1e10 or more are multiplied in two halves each."""
    price = F.col(price) if isinstance(price, str) else price
    small = (F.abs(price) < 10**10) & (F.abs(quantity) < 10**10)
    plain = price.cast("decimal(18,8)") * quantity.cast("decimal(18,8)")

    def halves(value: Column) -> tuple[Column, Column]:
        high = F.signum(value).cast("int") * F.floor(F.abs(value) / 10**8).cast("decimal(13,0)")
        return high.cast("decimal(13,0)"), (value - high.cast("decimal(13,0)") * F.lit(10**8).cast("decimal(9,0)")).cast("decimal(16,8)")

    (a, b), (c, d) = halves(price), halves(quantity)
    thousands = F.lit(10**8).cast("decimal(9,0)")
    cross = [((x * y).cast("decimal(28,8)") * thousands).cast(_PART) for x, y in ((a, d), (c, b))]
    top = ((a * c).cast("decimal(12,0)") * F.lit(10**16).cast("decimal(17,0)")).cast(_PART)
    wide = (top + cross[0]).cast(_PART) + (cross[1] + (b * d).cast(_PART)).cast(_PART)
    return F.when(small, plain.cast(AMOUNT)).otherwise(wide.cast(AMOUNT))


def fee_share(fee: Column, part: Column, whole: Column) -> Column:
    """The part of a fee that falls on ``part`` of the ``whole`` units; the whole fee for all of them.

    Spark keeps 18 places of a quotient below 1e12 units, and 8 beyond, which is then the
    precision of the amount."""
    usual = (F.abs(fee) < 10**10) & (whole < 10**12)
    rate = (part.cast("decimal(20,8)") / whole.cast("decimal(20,8)")).cast("decimal(19,18)")
    share = F.when(usual, (fee.cast("decimal(18,8)") * rate).cast(AMOUNT)).otherwise((_amount(fee, part) / whole).cast(AMOUNT))
    return F.when((whole == 0) | (part == 0), _zero(AMOUNT)).when(part == whole, fee.cast(AMOUNT)).otherwise(share)


def _fee_of(quantity: Column) -> Column:
    """Share of the fill's fee that falls on ``quantity`` of its units."""
    return fee_share(F.col("fee"), quantity, F.col("fee_quantity"))


def fill_usage(fills: DataFrame, cuts: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Per fill: what it closes and opens, its places on the axes, and what is left of it. A fill of zero quantity,
    whose side is not looked at, counts as a buy of nothing."""
    # rows are shuffled and sorted without what follows from their signed quantity
    follows = ["side", "quantity", *(["fee_quantity"] if "fee_quantity" not in fills.columns else [])]
    df = with_pieces(prepared_fills(fills, carry).drop(*follows), KEYS, order_value(ORDER), cuts)
    df = running_sums(df, KEYS, ORDER, {"position": F.col("signed")}, cuts, totals=True)
    quantity = F.abs("signed").cast(UNIT)
    before = (F.col("position") - F.col("signed")).cast(QUANTITY_SUM)
    closes = ((F.col("signed") > 0) & (before < 0)) | ((F.col("signed") < 0) & (before > 0))
    closing = F.when(closes, F.least(F.abs(before), quantity)).otherwise(_zero())
    df = df.withColumn("close_quantity", closing.cast(QUANTITY_SUM)).withColumn(
        "open_quantity", (quantity - F.col("close_quantity")).cast(QUANTITY_SUM)
    )
    buys = F.col("signed") >= 0
    opened = {
        "opened_long": F.when(buys, F.col("open_quantity")).otherwise(_zero()),
        "opened_short": F.when(~buys, F.col("open_quantity")).otherwise(_zero()),
    }
    df = running_sums(df, KEYS, ORDER, opened, cuts, totals=True)
    # closed units of a direction so far = opened so far minus what is held now
    own_opened = F.when(buys, F.col("opened_long")).otherwise(F.col("opened_short"))
    other_opened = F.when(buys, F.col("opened_short")).otherwise(F.col("opened_long"))
    other_held = F.greatest(F.when(buys, -F.col("position")).otherwise(F.col("position")), _zero())
    own_total = F.when(buys, F.col("opened_long_total")).otherwise(F.col("opened_short_total"))
    own_held = F.greatest(F.when(buys, F.col("position_total")).otherwise(-F.col("position_total")), _zero())
    consumed = (own_total - own_held).cast(QUANTITY_SUM)
    remaining = F.least(F.greatest(own_opened - consumed, _zero()), F.col("open_quantity")).cast(QUANTITY_SUM)
    return df.select(
        *KEYS,
        *ORDER,
        "fill_id",
        F.when(buys, "BUY").otherwise("SELL").alias("side"),
        F.when(buys, "long").otherwise("short").alias("open_direction"),
        F.when(buys, "short").otherwise("long").alias("close_direction"),
        quantity.alias("quantity"),
        "signed",
        "price",
        "fee",
        "fee_quantity" if "fee_quantity" in df.columns else quantity.alias("fee_quantity"),
        "close_quantity",
        "open_quantity",
        own_opened.alias("open_end"),
        (other_opened - other_held).cast(QUANTITY_SUM).alias("close_end"),
        remaining.alias("remaining_quantity"),
        *_currency(df),
        *carry,
        *([PIECE] if cuts is not None else []),
    )


def realized_contribution(carried: bool = False) -> Column:
    """What the consumed units of a fill add to realized profit: their cash, less their fee.

    ``carried`` fills may be rests of lots: they pay the share of all units used so far less the share
    paid before, so the shares of all parts add up to the fee."""
    used = (F.col("quantity") - F.col("remaining_quantity")).cast(QUANTITY_SUM)
    fee = _fee_of(used)
    if carried:
        earlier = (F.col("fee_quantity") - F.col("quantity")).cast(QUANTITY_SUM)
        so_far = (F.col("fee_quantity") - F.col("remaining_quantity")).cast(QUANTITY_SUM)
        fee = F.when(earlier > 0, _fee_of(so_far).cast(_PART) - _fee_of(earlier).cast(_PART)).otherwise(fee).cast(AMOUNT)
    return (F.when(F.col("side") == "SELL", _amount("price", used)).otherwise(-_amount("price", used)).cast(_PART) - fee.cast(_PART)).cast(AMOUNT)


def remaining_cost() -> Column:
    """Unit basis times what is left: fees raise the basis of longs and lower that of shorts."""
    left = F.col("remaining_quantity")
    fee = F.when(F.col("open_direction") == "long", _fee_of(left)).otherwise(-_fee_of(left))
    return (_amount("price", left) + fee).cast(AMOUNT)


def realized_by_instrument(fills: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return (
        fill_usage(fills, cuts)
        .groupBy(*KEYS)
        .agg(F.sum(realized_contribution()).cast(MONEY).alias("realized_pnl"), F.count(F.lit(1)).alias("fill_count"))
    )


def position_by_instrument(fills: DataFrame) -> DataFrame:
    """Signed open quantity; a plain aggregate with map-side combine."""
    return prepared_fills(fills).groupBy(*KEYS).agg(F.sum("signed").cast(MONEY).alias("position_qty"))


def latest_prices(fills: DataFrame) -> DataFrame:
    """Price (and functional currency where present) of the last fill of each instrument."""
    extra = [name for name in ("functional_currency",) if name in fills.columns]
    at = F.struct(*ORDER, "fill_id")
    return fills.groupBy(*KEYS).agg(
        F.max_by("price", at).cast(MONEY).alias("last_price"), *(F.max_by(name, at).alias(name) for name in extra)
    )


def instrument_summary(fills: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Everything a snapshot needs per instrument, in one pass of running sums and one aggregate."""
    left = F.col("remaining_quantity")
    longs = F.col("open_direction") == "long"
    at = F.struct(*ORDER, "fill_id")
    summary = (
        fill_usage(fills, cuts)
        .groupBy(*piece_keys(KEYS, None))  # as the windows are sorted
        .agg(
            *(F.max_by(name, at).alias(name) for name in _currency(fills)),
            F.sum("signed").cast(MONEY).alias("position_qty"),
            F.sum(realized_contribution()).cast(AMOUNT).alias("fifo_realized"),
            F.count_if(left > 0).alias("open_lot_count"),
            F.sum(F.when(longs & (left > 0), remaining_cost()).otherwise(_zero(AMOUNT))).cast(AMOUNT).alias("long_cost"),
            F.sum(F.when(left == 0, _zero(AMOUNT)).when(longs, remaining_cost()).otherwise(-remaining_cost())).cast(AMOUNT).alias("net_cost"),
            F.sum("fee").cast(AMOUNT).alias("trade_fees"),
        )
        .withColumn("cost_basis", F.when(F.col("open_lot_count") > 0, F.col("long_cost")).cast(MONEY))
    )
    return summary.select(*KEYS, *(name for name in summary.columns if name not in KEYS))


def unrealized_at_mark(fills: DataFrame, marks: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Open lots valued at ``mark_price`` per instrument (``marks`` has one row per key)."""
    held = instrument_summary(fills, cuts).select(*KEYS, "position_qty", "net_cost")
    value = _amount(F.col("mark_price").cast(UNIT), F.col("position_qty")) - F.col("net_cost")
    return held.join(marks.select(*KEYS, "mark_price"), KEYS).select(
        *KEYS, "position_qty", "mark_price", value.cast(MONEY).alias("unrealized_pnl")
    )


def _axis_rows(usage: DataFrame) -> DataFrame:
    """Opening and closing intervals of all fills as one table of interval ends."""
    extra = [PIECE] if PIECE in usage.columns else []
    facts = F.struct(
        "fill_id", "trade_timestamp_utc", "price", "fee", "fee_quantity", "quantity",
        "open_quantity", "remaining_quantity", "source_raw_record_id", *(name for name in ("report_date_local",) if name in usage.columns),
    )
    none = F.lit(None)
    kinds = F.array(
        F.struct(
            F.col("open_direction").alias("direction"), F.col("open_end").alias("end"),
            (F.col("open_quantity") > 0).alias("real"), F.lit(True).alias("opens"),
        ),
        F.struct(
            F.col("close_direction").alias("direction"), F.col("close_end").alias("end"),
            (F.col("close_quantity") > 0).alias("real"), F.lit(False).alias("opens"),
        ),
    )
    rows = usage.select(*KEYS, *extra, facts.alias("fact"), F.inline(F.filter(kinds, lambda kind: kind["real"])))
    return rows.select(
        *AXIS,
        *extra,
        "end",
        F.when(F.col("opens"), F.col("fact")).otherwise(none).alias("opened_by"),
        F.when(~F.col("opens"), F.col("fact")).otherwise(none).alias("closed_by"),
    )


def _axis_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts on the axis of hot keys: where their time pieces end, so a piece of the axis
    never holds more than one time piece of openings and one of closings."""
    ends = hot_rows(rows, KEYS, cuts).groupBy(*AXIS, PIECE, F.col("opened_by").isNull().alias("kind")).agg(
        F.max("end").alias("end")
    )
    return ends.groupBy(*AXIS).agg(in_blocks(F.array_sort(F.collect_set("end"))).alias("cuts"))


def lot_segments(usage: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Pieces of the axis with the fill that opened and the fill that closed them (null: still open)."""
    rows = _axis_rows(usage)
    axis_cuts = None
    if cuts is not None:
        axis_cuts = _axis_cuts(rows, cuts)
        rows = with_pieces(rows.drop(PIECE), AXIS, F.col("end"), axis_cuts)
    backward = Window.partitionBy(*piece_keys(AXIS, axis_cuts)).orderBy(F.desc("end"))
    covering = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = rows.select(
        *AXIS,
        *([PIECE] if axis_cuts is not None else []),
        "end",
        F.lead("end").over(backward).alias("start"),
        F.last("opened_by", ignorenulls=True).over(covering).alias("opened_by"),
        F.last("closed_by", ignorenulls=True).over(covering).alias("closed_by"),
    )
    if axis_cuts is not None:
        merged = _carry_between_pieces(rows, merged, axis_cuts)
    start = F.coalesce("start", _zero())
    return merged.withColumn("matched_quantity", (F.col("end") - start).cast(QUANTITY_SUM)).where(
        F.col("matched_quantity") > 0
    )


def _carry_between_pieces(rows: DataFrame, merged: DataFrame, axis_cuts: DataFrame) -> DataFrame:
    """Complete the first rows of a piece from the piece before and the last ones from those after."""
    edges = hot_rows(rows, AXIS, axis_cuts).groupBy(*AXIS, PIECE).agg(
        F.max("end").alias("last_end"),
        F.min_by("opened_by", F.when(F.col("opened_by").isNotNull(), F.col("end"))).alias("first_open"),
        F.min_by("closed_by", F.when(F.col("closed_by").isNotNull(), F.col("end"))).alias("first_close"),
    )
    later = Window.partitionBy(*AXIS).orderBy(F.desc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *AXIS,
        PIECE,
        F.lead("last_end").over(Window.partitionBy(*AXIS).orderBy(F.desc(PIECE))).alias("_start"),
        F.last("first_open", ignorenulls=True).over(later).alias("_open"),
        F.last("first_close", ignorenulls=True).over(later).alias("_close"),
    )
    joined = merged.join(F.broadcast(carried), [*AXIS, PIECE], "left")
    return joined.select(
        *AXIS,
        "end",
        F.coalesce("start", "_start").alias("start"),
        F.coalesce("opened_by", "_open").alias("opened_by"),
        F.coalesce("closed_by", "_close").alias("closed_by"),
    )


def match_profit() -> Column:
    """(close price - unit basis) x quantity for longs, the reverse for shorts."""
    opened, closed, matched = F.col("opened_by"), F.col("closed_by"), F.col("matched_quantity")
    gain = _amount(closed["price"], matched) - _amount(opened["price"], matched)
    open_fee = fee_share(opened["fee"], matched, opened["fee_quantity"])
    return (F.when(F.col("direction") == "long", gain).otherwise(-gain) - open_fee).cast(AMOUNT)


def lot_matches(fills: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """One row per (opening fill, closing fill) with the matched quantity and its profit before close fees."""
    segments = lot_segments(fill_usage(fills, cuts), cuts).where(F.col("closed_by").isNotNull())
    return segments.select(
        *AXIS,
        F.col("opened_by.fill_id").alias("open_fill_id"),
        F.col("closed_by.fill_id").alias("close_fill_id"),
        F.col("matched_quantity").cast(MONEY).alias("matched_quantity"),
        F.col("opened_by.price").cast(MONEY).alias("open_price"),
        F.col("closed_by.price").cast(MONEY).alias("close_price"),
        match_profit().cast(MONEY).alias("match_pnl"),
    )


def position_lots(fills: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Every lot ever opened, open or closed, with what was realized on it before close fees."""
    segments = lot_segments(fill_usage(fills, cuts), cuts)
    matched = F.col("closed_by").isNotNull()
    lots = segments.groupBy(*AXIS, F.col("opened_by.fill_id").alias("open_fill_id")).agg(
        F.any_value("opened_by").alias("o"),
        F.sum(F.when(matched, match_profit()).otherwise(_zero(AMOUNT))).cast(AMOUNT).alias("realized"),
        F.max("closed_by.trade_timestamp_utc").alias("last_close"),
    )
    opened, left = F.col("o.open_quantity"), F.col("o.remaining_quantity")
    open_fee = fee_share(F.col("o.fee"), opened, F.col("o.fee_quantity"))
    value = _amount(F.col("o.price"), opened)
    cost = F.when(F.col("direction") == "long", value).otherwise(-value) + open_fee
    is_open = left > 0
    return lots.select(
        lot_id(F.col("account_id"), F.col("instrument_id"), F.col("open_fill_id")).alias("position_lot_id"),
        *KEYS,
        F.col("open_fill_id").alias("open_event_trade_fill_id"),
        "direction",
        F.col("o.trade_timestamp_utc").alias("opened_at_utc"),
        F.when(~is_open, F.col("last_close")).alias("closed_at_utc"),
        opened.cast(MONEY).alias("open_quantity"),
        left.cast(MONEY).alias("remaining_quantity"),
        F.col("o.price").cast(MONEY).alias("open_price"),
        cost.cast(MONEY).alias("cost_basis_open"),
        F.col("realized").cast(MONEY).alias("realized_pnl_to_date"),
        F.when(is_open, "open").otherwise("closed").alias("status"),
    )


def open_lots(fills: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    return position_lots(fills, cuts).where(F.col("status") == "open")
