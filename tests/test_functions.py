from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from uuid import NAMESPACE_URL, uuid5

import pytest
from pyspark.sql import functions as F

from tallystone.functions import dates, ids, text, timeline


def each(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r.x for r in rows.withColumn("x", expression).orderBy("i").collect()]


def test_optional_text(spark):
    values = [None, "", "  ", "-", "--", "N/A", " value ", "\tx\n"]
    assert each(spark, values, text.optional_text(F.col("v"))) == [None, None, None, None, None, None, "value", "x"]


def test_required_text_keeps_dashes(spark):
    assert each(spark, [None, " ", "-", " a "], text.required_text(F.col("v"))) == [None, None, "-", "a"]


def test_local_date(spark):
    day = date(2026, 2, 14)
    good = [
        "2026-02-14", "20260214", "2026/02/14", "02/14/2026", "02/14/26", "14-Feb-26", "2026-02-14T10:00:00+00:00", "14-FEB-26",
        "20260214;101500", "2026-02-14 10:00", "2/14/2026", "2026-02-14,10:00:00",
    ]
    assert each(spark, good, dates.local_date(F.col("v"))) == [day] * len(good)
    bad = ["", "14-02-2026", "2026-13-01", "2026-02/14", "tomorrow", "2026-02-14,29:00:00"]
    assert each(spark, bad, dates.local_date(F.col("v"))) == [None] * len(bad)
    assert each(spark, ["01-Jan-69", "01-Jan-68", "1/1/70"], dates.local_date(F.col("v"))) == [date(1969, 1, 1), date(2068, 1, 1), date(1970, 1, 1)]


CASES = {
    "2026-02-14T12:00:00+02:00": datetime(2026, 2, 14, 10),
    "2026-02-14T10:00:00Z": datetime(2026, 2, 14, 10),
    "20260214;101500": datetime(2026, 2, 14, 10, 15),
    "2026-02-14, 10:15:00": datetime(2026, 2, 14, 10, 15),
    "20260214T101500": datetime(2026, 2, 14, 10, 15),
    "2026-02-14": datetime(2026, 2, 14),
    "2026-02-14 10:15:20.5-0530": datetime(2026, 2, 14, 15, 45, 20, 500000),
    "20 February, 2026 02:15 PM EST": datetime(2026, 2, 20, 19, 15),
    "20 February, 2026 02:15 PM EDT": datetime(2026, 2, 20, 18, 15),
    "": None,
    "2026/02/14 10:00:00": None,
    "20 Foo, 2026 02:15 PM EST": None,
    "2026-02-30T10:00:00": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_utc_instant_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert each(spark, list(CASES), dates.utc_instant(F.col("v"))) == list(CASES.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_business_date_follows_daylight_saving(spark):
    at = F.col("v").cast("timestamp_ntz")
    values = ["2026-03-27 00:30:00", "2026-10-25 00:30:00", "2026-01-10 21:59:59", "2026-01-10 22:00:00", "2026-07-10 21:00:00"]
    want = [date(2026, 3, 27), date(2026, 10, 25), date(2026, 1, 10), date(2026, 1, 11), date(2026, 7, 11)]
    assert each(spark, values, dates.business_date(at)) == want
    starts = each(spark, ["2026-01-11", "2026-07-11"], dates.business_day_start(F.col("v").cast("date")))
    assert starts == [datetime(2026, 1, 10, 22), datetime(2026, 7, 10, 21)]


def test_decimal_value(spark):
    values = ["1,234.56", "1e5", "NaN", "Infinity", "abc", "-7", "1_000"]
    want = [Decimal("1234.56"), Decimal(100000), None, None, None, Decimal(-7), Decimal(1000)]
    assert each(spark, values, text.decimal_value(F.col("v"))) == want


def test_mixed_date_and_period_key(spark):
    assert each(spark, ["20260214", "2026-02-14", "", None], dates.mixed_date(F.col("v"))) == [date(2026, 2, 14), date(2026, 2, 14), None, None]
    assert each(spark, ["2026-02-14", "2026-02-30", "20260214", " "], dates.is_period_key(F.col("v"))) == [True, False, False, False]


def test_name_uuid_is_version_5(spark):
    names = ["U1:17:x-1", "", "é:ß"]
    assert each(spark, names, ids.name_uuid(F.col("v"))) == [str(uuid5(NAMESPACE_URL, n)) for n in names]


def test_timeline_lookups(spark):
    at = F.lit("2026-01-01").cast("timestamp_ntz")
    event = lambda stage, status, **f: timeline.stage_event(F.lit(stage), F.lit(status), at, **f)
    details = lambda n: F.create_map(F.lit("n"), F.lit(n))
    lists = F.array(F.lit("Trades"))
    row = spark.range(1).select(
        F.array(
            event("canonical_mapping", "completed", details=details("1")),
            event("preflight", "failed", error_code=F.lit("MISSING_REQUIRED_SECTION"), missing_sections=lists),
            event("canonical_mapping", "completed", details=details("2")),
            event("canonical_mapping", "started"),
        ).alias("t")
    )
    got = row.select(timeline.missing_sections(F.col("t")).alias("m"), timeline.last_completed_details(F.col("t")).alias("d")).first()
    assert got.m.missing_sections == ["Trades"] and got.m.missing_hard_required == [] and got.d == {"n": "2"}
