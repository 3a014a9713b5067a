"""Registered queries over the star-schema tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import dates, ids, text, timeline
from tallystone.operators import corporate, export, fallback, fifo, listing, mapping, merge, preflight, quality, reports, runs, series, snapshot
from tallystone.operators.scan import split_points
from tallystone import schemas
from tallystone.plans import jobs, publish
from tallystone.plans.store import Store
from tallystone.schemas import NATURAL_KEYS
from tallystone.session import CODEC, discard, scratch_path, stored
from tallystone.sources import pieces, star, statements, tables
from tallystone.streaming import incremental, lots, state

TRADE_ORDER = ("trade_timestamp_utc", "source_raw_record_id")
CASH_ORDER = ("effective_at_utc", "source_raw_record_id")
DAY_ORDER = ("report_date_local", "source_raw_record_id")
SNAPSHOT_DATE = "2001-12-31"
FIRST_LOAD_END = "1998-01-01"
RETENTION_AS_OF = "2024-04-01"


SPLIT_ROWS = 20  # keys above this many fills are cut in the *_split queries


def _cuts(spark: SparkSession, folder: str, totals: DataFrame | None = None, **limits: int) -> DataFrame | None:
    return fifo.fifo_cuts(star.fill_profile(spark, folder), totals if totals is None else totals.select(*fifo.KEYS, "count"), **limits)


def fifo_realized(spark: SparkSession, folder: str) -> DataFrame:
    return fifo.realized_by_instrument(star.fills(spark, folder), _cuts(spark, folder))


def fifo_realized_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with most keys cut into pieces, as hot keys are."""
    return fifo.realized_by_instrument(star.fills(spark, folder), _cuts(spark, folder, min_rows=SPLIT_ROWS))


def fifo_matches_split(spark: SparkSession, folder: str) -> DataFrame:
    return fifo.lot_matches(star.fills(spark, folder), _cuts(spark, folder, min_rows=SPLIT_ROWS))


def fifo_uneven_fees(spark: SparkSession, folder: str) -> DataFrame:
    """Realized profit where fees don't divide by quantities, some quantities are zero or
    negative, and some lie above 1e10."""
    return fifo.realized_by_instrument(star.uneven_fills(spark, folder))


def fifo_position(spark: SparkSession, folder: str) -> DataFrame:
    return fifo.position_by_instrument(star.fills(spark, folder))


def fifo_open_lots(spark: SparkSession, folder: str) -> DataFrame:
    return fifo.open_lots(star.fills(spark, folder), _cuts(spark, folder)).drop("closed_at_utc", "position_lot_id")


def fifo_matches(spark: SparkSession, folder: str) -> DataFrame:
    return fifo.lot_matches(star.fills(spark, folder), _cuts(spark, folder))


def position_lots(spark: SparkSession, folder: str) -> DataFrame:
    lots = fifo.position_lots(star.fills(spark, folder), _cuts(spark, folder))
    return lots.select("account_id", "instrument_id", "open_event_trade_fill_id", "closed_at_utc", "realized_pnl_to_date", "status")


def lot_ids(spark: SparkSession, folder: str) -> DataFrame:
    lots = star.fills(spark, folder).select("account_id", "instrument_id", "fill_id")
    return lots.withColumn("position_lot_id", ids.lot_id(F.col("account_id"), F.col("instrument_id"), F.col("fill_id")))


def last_price(spark: SparkSession, folder: str) -> DataFrame:
    return fifo.latest_prices(star.fills(spark, folder))


def fifo_unrealized_at_mark(spark: SparkSession, folder: str) -> DataFrame:
    fills = star.fills(spark, folder)
    marks = fifo.latest_prices(fills).withColumnRenamed("last_price", "mark_price")
    return fifo.unrealized_at_mark(fills, marks, _cuts(spark, folder))


def open_cost_basis(spark: SparkSession, folder: str) -> DataFrame:
    held = fifo.instrument_summary(star.fills(spark, folder), _cuts(spark, folder))
    return held.select("account_id", "instrument_id", "open_lot_count", "cost_basis")


def fees_by_instrument(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.trade_fee_totals(star.fills(spark, folder))


def cash_totals(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot.cash_totals(merged_cashflows(spark, folder))


def merged_cashflows(spark: SparkSession, folder: str) -> DataFrame:
    return merge.merge_cashflows(None, star.cashflow_raw(spark, folder), CASH_ORDER)


def valuation_latest(spark: SparkSession, folder: str, totals: DataFrame | None = None) -> DataFrame:
    raw = tables.raw_rows_of_run(star.open_position_raw(spark, folder, totals), "run-1")
    return tables.open_positions(raw, star.account_instruments(spark, folder, totals))


def snapshot_daily(spark: SparkSession, folder: str, held: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    held = _held(spark, folder) if held is None else held
    totals = _totals(held) if totals is None else totals
    return snapshot.build_snapshot(
        held,
        tables.cashflows(merged_cashflows(spark, folder)),
        valuation_latest(spark, folder, totals),
        SNAPSHOT_DATE,
        "run-1",
        _cuts(spark, folder, totals),
    )


SERIES_DATES = ("1993-06-30", "1995-12-31", "1996-12-31", "1998-03-31", "2001-12-31")


def snapshot_series(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots of several report dates from one pass over the fills."""
    return _series(spark, folder)


def _series(spark: SparkSession, folder: str, **limits: int) -> DataFrame:
    fills = _held(spark, folder)
    totals = _totals(fills)
    cash = tables.cashflows(merged_cashflows(spark, folder))
    rows = series.snapshot_series(fills, cash, valuation_latest(spark, folder, totals), SERIES_DATES, "run-1", _cuts(spark, folder, totals, **limits))
    discard(fills)  # what is held was stored
    return rows


def snapshot_series_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with most keys cut into pieces, as hot keys are."""
    return _series(spark, folder, min_rows=SPLIT_ROWS)


def snapshot_publish(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots published date by date, one date first with wrong amounts and then again, read back for a range of dates."""
    path, rows = scratch_path(spark, "snapshots"), stored(snapshot_series(spark, folder), "series")
    wrong = rows.where(F.col("report_date_local") == SERIES_DATES[2]).withColumn("realized_pnl", F.col("realized_pnl") + 1).where(F.col("account_id") != "U1")
    publish.publish_days(wrong.select(*rows.columns), path)
    for day in (SERIES_DATES[1], SERIES_DATES[0], *SERIES_DATES[2:], SERIES_DATES[1]):
        publish.publish_days(rows.where(F.col("report_date_local") == day), path)
    return publish.published_days(spark, path, first=SERIES_DATES[1], last=SERIES_DATES[3])


def _as_fills(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"fill_id": F.col("ib_exec_id"), "fees": fifo.trade_fee(F.col("fees"), F.col("commission"))}
    ).drop("commission")


def _held(spark: SparkSession, folder: str) -> DataFrame:
    """The fills of a snapshot, stored: lots, valuations and counters read them."""
    fills = tables.fills(star.first_trades(spark, folder)).transform(_as_fills).drop("currency", "ib_exec_id")
    return stored(fills, "fills")


def _totals(held: DataFrame) -> DataFrame:
    """What cuts, valuations and instruments need of each key, from one pass over the fills."""
    return stored(star.key_totals(held), "totals")


def snapshot_counters(spark: SparkSession, folder: str) -> DataFrame:
    held = _held(spark, folder)
    totals = _totals(held)
    fills = held.where(F.col("report_date_local") <= F.lit(SNAPSHOT_DATE).cast("date"))
    usage_lots = (
        fifo.fill_usage(fills, _cuts(spark, folder, totals))
        .where(F.col("remaining_quantity") > 0)
        .select("account_id", F.lit("open").alias("status"))
    )
    return snapshot.snapshot_counters(snapshot_daily(spark, folder, held, totals), usage_lots)


# merges: a first load up to a date, then a batch with the rest


def _loads(df: DataFrame, day: str, end: str = FIRST_LOAD_END) -> tuple[DataFrame, DataFrame]:
    early = F.col(day).cast("date") < F.lit(end).cast("date")
    return df.where(early), df.where(~early)


def trade_merge(spark: SparkSession, folder: str) -> DataFrame:
    first, rest = _loads(star.trade_raw(spark, folder), "trade_timestamp_utc")
    return merge.merge_trades(merge.merge_trades(None, first, TRADE_ORDER), rest, TRADE_ORDER)


def cashflow_merge(spark: SparkSession, folder: str) -> DataFrame:
    first, rest = _loads(star.cashflow_raw(spark, folder), "report_date_local", "2024-02-01")
    return merge.merge_cashflows(merge.merge_cashflows(None, first, CASH_ORDER), rest, CASH_ORDER)


def _fx_events(spark: SparkSession, folder: str) -> DataFrame:
    missing = F.col("fx_rate").isNull()
    return star.fx_raw(spark, folder).withColumns(
        {
            "fx_source": F.lit(mapping.FX_SOURCE),
            "provisional": missing,
            "diagnostic_code": F.when(missing, mapping.FX_MISSING),
        }
    )


def fx_merge(spark: SparkSession, folder: str) -> DataFrame:
    first, rest = _loads(_fx_events(spark, folder), "report_date_local")
    return merge.merge_fx(merge.merge_fx(None, first, DAY_ORDER), rest, DAY_ORDER)


def corp_action_merge(spark: SparkSession, folder: str) -> DataFrame:
    first, rest = _loads(star.corp_action_raw(spark, folder), "report_date_local")
    return merge.merge_corp_actions(merge.merge_corp_actions(None, first, DAY_ORDER), rest, DAY_ORDER)


def instrument_merge(spark: SparkSession, folder: str) -> DataFrame:
    first, rest = _loads(star.instrument_requests(spark, folder), "trade_timestamp_utc")
    return merge.merge_instruments(merge.merge_instruments(None, first, TRADE_ORDER), rest, TRADE_ORDER)


def raw_dedupe_counts(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["account_id", "section_name", "source_row_ref"]
    rows = star.raw_records(spark, folder, with_payload=False).select(*keys, "ingestion_run_id", "raw_record_id", "created_at_utc")
    first, rest = _loads(rows, "created_at_utc")
    return merge.insert_counts(first, rest, keys, by=["section_name"])


def artifact_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of the documents as payloads of their source and language."""
    documents = star.table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("account_id"), F.col("lang").alias("period_key"), F.lit("q1").alias("flex_query_id"),
        F.col("text").alias("payload"),
    )
    keyed = statements.artifact_rows(documents).drop("payload")
    flagged = merge.flag_deduplicated(None, keyed, NATURAL_KEYS["raw_artifact"], "doc_id")
    return flagged.select("doc_id", "raw_artifact_id", "payload_sha256", "deduplicated")


# mapping


def map_trades(spark: SparkSession, folder: str) -> DataFrame:
    mapped = mapping.clean(mapping.map_trades(star.raw_records(spark, folder), star.BASE_CURRENCY))
    return mapped.select(
        "source_raw_record_id", "account_id", "ib_exec_id", "conid", "side", "quantity", "price", "currency", "trade_timestamp_utc",
        "report_date_local", "commission", "fees", "fx_rate_to_base", "symbol", "asset_category", "instrument_description",
    )


def map_cashflows(spark: SparkSession, folder: str) -> DataFrame:
    mapped = mapping.clean(mapping.map_cashflows(star.raw_records(spark, folder), star.BASE_CURRENCY))
    return mapped.select(
        "source_raw_record_id", "account_id", "transaction_id", "cash_action", "conid", "symbol", "amount", "currency",
        "effective_at_utc", "report_date_local", "withholding_tax", "fees",
    )


def map_fx(spark: SparkSession, folder: str) -> DataFrame:
    mapped = mapping.clean(mapping.map_fx(star.raw_records(spark, folder), star.BASE_CURRENCY))
    return mapped.select(
        "source_raw_record_id", "account_id", "transaction_id", "report_date_local", "currency", "functional_currency", "fx_rate",
        "fx_source", "provisional", "diagnostic_code",
    )


def map_corp_actions(spark: SparkSession, folder: str) -> DataFrame:
    mapped = mapping.clean(mapping.map_corp_actions(star.raw_records(spark, folder)))
    return mapped.select(
        "source_raw_record_id", "account_id", "action_id", "transaction_id", "conid", "reorg_code", "report_date_local",
        "currency", "description", "requires_manual",
    )


def map_violations(spark: SparkSession, folder: str) -> DataFrame:
    batch = mapping.build_canonical(star.raw_records(spark, folder), star.BASE_CURRENCY)
    return batch.violations.select("raw_record_id", "section_name", "source_row_ref", "field", "reason", "value")


def row_tag_route(spark: SparkSession, folder: str) -> DataFrame:
    raw = star.raw_records(spark, folder)
    where = mapping.route(F.col("section_name"), F.col("source_row_ref"), F.col("source_payload"))
    return raw.groupBy("section_name", where.alias("destination")).agg(F.count(F.lit(1)).alias("row_count"))


def batch_counters(spark: SparkSession, folder: str) -> DataFrame:
    return mapping.batch_counts(mapping.build_canonical(star.raw_records(spark, folder), star.BASE_CURRENCY))


def resolved_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events per kind with and without a known instrument."""
    batch = mapping.build_canonical(star.raw_records(spark, folder), star.BASE_CURRENCY, hold=stored)
    known = stored(merge.merge_instruments(None, batch.instruments).select(*NATURAL_KEYS["instrument"]), "instruments")
    rows = None
    for kind, df in (("trade", batch.trades), ("cashflow", batch.cashflows), ("corp_action", batch.corp_actions)):
        linked = mapping.with_instrument(mapping.event_counts(df), known)
        counted = linked.groupBy("account_id").agg(
            F.sum("n").alias("event_count"), F.sum(F.when(F.col("instrument_id").isNotNull(), F.col("n")).otherwise(0)).alias("resolved_count")
        ).withColumn("kind", F.lit(kind))
        rows = counted if rows is None else rows.unionByName(counted)
    return rows


# statements


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return statements.parse_payloads(star.statement_payloads(star.table(spark, folder, "orders")))


def xml_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = statements.raw_rows(statements.good_rows(_parsed(spark, folder)))
    entries = F.transform(F.array_sort(F.map_entries("source_payload")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("payload_id", "section_name", "source_row_ref", F.array_join(entries, ";").alias("attributes"))


def statement_files(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows of files that hold a year of statements each, read in pieces of 1 MB (larger ones beyond 4 GB of files)."""
    path = scratch_path(spark, "statement_files")
    star.write_statement_files(star.table(spark, folder, "orders"), path)
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    rows = statements.raw_rows(statements.good_rows(pieces.parse_files(spark, path, max(1 << 20, size >> 12))))
    entries = F.transform(F.array_sort(F.map_entries("source_payload")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    year = F.regexp_extract("payload_id", "/year=([0-9]+)/", 1).cast("int").alias("file_year")
    return rows.select(year, "statement_index", "section_index", "source_row_ref", F.array_join(entries, ";").alias("attributes"))


def xml_rejected(spark: SparkSession, folder: str) -> DataFrame:
    return statements.rejected_payloads(_parsed(spark, folder))


def statement_dates(spark: SparkSession, folder: str) -> DataFrame:
    return statements.report_dates(statements.good_rows(_parsed(spark, folder)))


def required_sections(spark: SparkSession, folder: str) -> DataFrame:
    sections = statements.section_names(statements.good_rows(_parsed(spark, folder)))
    checked = preflight.check_sections(sections, reconciliation=True)
    lists = ("detected_sections", "missing_hard_required", "missing_reconciliation_required", "missing_sections")
    return checked.select("payload_id", *(F.array_join(name, ",").alias(name) for name in lists), "is_valid")


# scalar functions


def parse_dates(spark: SparkSession, folder: str) -> DataFrame:
    order = star.table(spark, folder, "orders")
    at, key = F.col("o_orderdate"), F.col("o_orderkey")
    forms = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "MM/dd/yyyy", "MM/dd/yy", "dd-MMM-yy", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "dd-MM-yyyy", "yyyyMMdd;HHmmss", "yyyy/MM/dd HH:mm", " M/d/yyyy ")
    written = F.when(key % len(forms) == 0, F.date_format(at, forms[0]))
    for i, form in enumerate(forms[1:], 1):
        written = written.when(key % len(forms) == i, F.date_format(at, form))
    return order.select("o_orderkey", (key % len(forms)).cast("int").alias("form"), dates.local_date(written).alias("parsed_date"))


def parse_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    event = star.table(spark, folder, "events")
    at, key = F.col("ts"), F.col("event_id")
    forms = (
        "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd;HHmmss", "yyyy-MM-dd,HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "d MMMM, yyyy hh:mm a 'EST'",
        "d MMMM, yyyy hh:mm a 'EDT'", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyyMMdd'T'HHmmss", "yyyy-MM-dd",
    )
    written = F.when(key % len(forms) == 0, F.date_format(at, forms[0]))
    for i, form in enumerate(forms[1:], 1):
        written = written.when(key % len(forms) == i, F.date_format(at, form))
    return event.select("event_id", (key % len(forms)).cast("int").alias("form"), dates.utc_instant(written).alias("parsed_at"))


def parse_decimals(spark: SparkSession, folder: str) -> DataFrame:
    order = star.table(spark, folder, "orders")
    key, plain = F.col("o_orderkey"), star.cents(F.col("o_totalprice"))
    written = (
        F.when(key % 7 == 0, F.call_function("format_number", plain, F.lit("#,##0.00")))
        .when(key % 7 == 1, F.concat(F.lit("-"), plain.cast("string")))
        .when(key % 7 == 2, "NaN")
        .when(key % 7 == 3, " - ")
        .when(key % 7 == 4, F.concat(F.lit(" "), plain.cast("string"), F.lit("e2 ")))
        .when(key % 7 == 5, F.concat(plain.cast("string"), F.lit("x")))
        .otherwise(plain.cast("string"))
    )
    return order.select("o_orderkey", text.decimal_value(text.optional_text(written)).alias("parsed_value"))


def optional_texts(spark: SparkSession, folder: str) -> DataFrame:
    order = star.table(spark, folder, "orders")
    written = F.element_at(
        F.array(F.lit("-"), F.lit(" -- "), F.lit("N/A"), F.lit("\t"), F.lit(""), F.concat(F.lit(" "), "o_orderpriority", F.lit("\n"))),
        (F.col("o_orderkey") % 6 + 1).cast("int"),
    )
    return order.select("o_orderkey", text.optional_text(written).alias("normalized"), text.required_text(written).alias("required"))


def business_date(spark: SparkSession, folder: str) -> DataFrame:
    event = star.table(spark, folder, "events")
    return event.select("event_id", dates.business_date(F.col("ts")).alias("report_date_local"), dates.period_key(F.col("ts")).alias("period_key"))


def business_date_range(spark: SparkSession, folder: str) -> DataFrame:
    event = star.table(spark, folder, "events")
    wanted = reports.in_business_dates(event, "ts", "2024-01-10", "2024-02-05")
    return wanted.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# listings and runs


def _listed_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshot_daily(spark, folder)
    key = [F.col(n).cast("string") for n in NATURAL_KEYS["pnl_snapshot_daily"]]
    return rows.withColumns(
        {
            "pnl_snapshot_daily_id": ids.natural_uuid("snapshot", *key),
            "created_at_utc": F.to_timestamp_ntz(F.concat(F.col("report_date_local").cast("string"), F.lit(" 12:00:00"))),
        }
    )


def snapshot_list(spark: SparkSession, folder: str) -> DataFrame:
    found = listing.list_snapshots(
        _listed_snapshots(spark, folder), "U1", "total_pnl", "desc", limit=500, offset=10, date_from="2000-01-01", date_to="2002-12-31"
    )
    return found.rows.select("account_id", "instrument_id", "report_date_local", "total_pnl", "pnl_snapshot_daily_id")


def snapshot_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = snapshot_daily(spark, folder).select("instrument_id", "report_date_local", "position_qty", "cost_basis", "provisional", "account_id")
    return export.as_json(rows)


def run_state(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_states(star.run_events(spark, folder))


def _listed_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_state(spark, folder).withColumnRenamed("run_id", "ingestion_run_id")


def run_list(spark: SparkSession, folder: str) -> DataFrame:
    found = listing.list_runs(_listed_runs(spark, folder), "duration_ms", "desc", limit=100, offset=5)
    return found.rows.select("ingestion_run_id", "status", "started_at_utc", "ended_at_utc", "duration_ms")


def run_filters(spark: SparkSession, folder: str) -> DataFrame:
    found = listing.list_runs(
        _listed_runs(spark, folder), "started_at_utc", "desc", limit=50, status="success", run_type="manual", from_utc="2024-01-05", to_utc="2024-02-20"
    )
    total = found.matching.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.rows.select("ingestion_run_id", "started_at_utc", "run_type", "status", total.alias("total"), (total > found.offset + found.applied_limit).alias("has_more"))


def instrument_list(spark: SparkSession, folder: str) -> DataFrame:
    label = "type:ECONOMY"
    labels = star.labels(spark, folder)
    known = star.instruments(spark, folder).withColumn("updated_at_utc", F.lit(None).cast("timestamp_ntz"))
    found = listing.list_instruments(
        known, labels.withColumn("label_id", F.col("label_name")), "symbol", "desc", limit=60, label_id=label, search="RING", active_only=True
    )
    return found.rows.select("instrument_id", "conid", "symbol", "description")


def note_list(spark: SparkSession, folder: str) -> DataFrame:
    found = listing.list_notes(star.notes(spark, folder), limit=120, instrument_id="17", created_from="1996-01-01", created_to="2001-06-30")
    return found.rows


def timeline_last_stage(spark: SparkSession, folder: str) -> DataFrame:
    return runs.last_completed_stage(star.run_events(spark, folder), "purchase")


def _timelines(spark: SparkSession, folder: str) -> DataFrame:
    """Each event with a small timeline of its own."""
    event = star.run_events(spark, folder)
    k = F.col("k").cast("string")
    details = lambda n: F.create_map(F.lit("canonical_input_row_count"), (F.col("k") + n).cast("string"), F.lit("canonical_skip_reason"), F.when(F.col("k") == 0, "no_new_raw_rows_for_run"))
    first = timeline.stage_event(F.when(F.col("k") % 2 == 0, "canonical_mapping").otherwise("persist"), F.col("status"), F.col("at_utc"), details=details(0))
    second = timeline.stage_event(
        F.lit("preflight"), F.lit("failed"), F.col("at_utc"), error_code=F.when(F.col("k") % 3 == 0, timeline.MISSING_SECTION_CODE),
        missing_sections=F.array(F.lit("Trades"), k), missing_hard_required=F.array(F.lit("Trades")),
        missing_reconciliation_required=F.when(F.col("k") % 6 == 0, F.array(k)),
    )
    third = timeline.stage_event(F.when(F.col("k") % 5 == 0, "canonical_mapping").otherwise("snapshot"), F.lit("completed"), F.col("at_utc"), details=details(1000))
    return event.select("event_id", F.array(first, second, third).alias("timeline"))


def missing_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = _timelines(spark, folder).select("event_id", timeline.missing_sections(F.col("timeline")).alias("m"))
    return rows.select("event_id", *(F.array_join(F.col(f"m.{n}"), ",").alias(n) for n in ("missing_sections", "missing_hard_required", "missing_reconciliation_required")))


def canonical_details(spark: SparkSession, folder: str) -> DataFrame:
    details = timeline.last_completed_details(F.col("timeline"))
    return _timelines(spark, folder).select(
        "event_id", *(F.try_element_at(details, F.lit(n)).alias(n) for n in ("canonical_input_row_count", "canonical_skip_reason"))
    )


def error_codes(spark: SparkSession, folder: str) -> DataFrame:
    event = star.run_events(spark, folder).where(F.col("status") == "failed")
    code = (F.lit(1000) + F.col("k") % 25).cast("string")
    kinds = (*runs.FAILURE_CODES, "other")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") % len(kinds) + 1).cast("int"))
    return event.select(
        "event_id",
        code.alias("status_code"),
        runs.status_message(code, F.lit("unknown")).alias("message"),
        runs.status_class(code).alias("status_class"),
        runs.retry_delay_seconds(code).alias("delay_seconds"),
        runs.run_error_code(kind).alias("ingest_code"),
        runs.run_error_code(kind, replay=True).alias("replay_code"),
    )


def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return runs.latest_run(run_state(spark, folder)).select("run_id", "started_at_utc", "status")


def slo_success_rate(spark: SparkSession, folder: str) -> DataFrame:
    return runs.success_rate(run_state(spark, folder))


def slo_p95(spark: SparkSession, folder: str) -> DataFrame:
    histogram = stored(runs.duration_histogram(run_state(spark, folder)), "durations")
    return runs.duration_p95(histogram, split_points(histogram, ["account_id", "run_date"], ["duration_ms"]))


def retention_split(spark: SparkSession, folder: str) -> DataFrame:
    split = runs.split_by_retention(star.run_events(spark, folder), RETENTION_AS_OF)
    return split.groupBy("retention_class", "archive_month").agg(F.count(F.lit(1)).alias("event_count"), F.min("at_utc").alias("first_at"), F.max("at_utc").alias("last_at"))


def _flawed_lots(spark: SparkSession, folder: str) -> DataFrame:
    """Lots as orders would have them, some with a number for an id, less than nothing left or a state of their own."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return star.table(spark, folder, "orders").select(
        F.when(key % 13 == 0, key.cast("string")).otherwise(ids.lot_id(F.col("o_custkey").cast("string"), (key % 500).cast("string"), day)).alias("position_lot_id"),
        F.when(key % 17 == 0, "pending").when(key % 2 == 0, "open").otherwise("closed").alias("status"),
        F.when(key % 19 == 0, -1).otherwise(key % 7).cast(text.MONEY).alias("remaining_quantity"),
    )


def _flawed_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Statement files, some filed under no real date, without a query or without a hash."""
    key = F.col("o_orderkey")
    return star.table(spark, folder, "orders").select(
        F.concat(F.lit("U"), (F.col("o_custkey") % 3).cast("string")).alias("account_id"),
        F.when(key % 23 == 0, "2026-02-30").when(key % 29 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("period_key"),
        F.when(key % 31 == 0, " ").otherwise("q1").alias("flex_query_id"),
        F.when(key % 37 == 0, F.lit(None)).otherwise(F.sha2((key % 50).cast("string"), 256)).alias("payload_sha256"),
    )


def dq_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every row rule, every natural key and the references, on views that break some of them."""
    trades, known = star.trade_raw(spark, folder), star.instruments(spark, folder)
    cash, actions, rates = star.cashflow_raw(spark, folder), star.corp_action_raw(spark, folder), star.fx_raw(spark, folder)
    raw = star.raw_records(spark, folder, with_payload=False).withColumns({"raw_artifact_id": F.concat_ws("/", "account_id", "ingestion_run_id"), "statement_index": F.lit(0)})
    snapshots = trades.select("account_id", "report_date_local", "instrument_id")
    instruments = star.instrument_requests(spark, folder)
    checked = {
        "event_trade_fill": trades, "event_cashflow": cash, "event_fx": rates, "event_corp_action": actions, "note": star.notes(spark, folder), "ingestion_run": run_state(spark, folder),
        "position_lot": _flawed_lots(spark, folder), "raw_artifact": _flawed_artifacts(spark, folder), "raw_record": raw, "instrument": instruments, "pnl_snapshot_daily": snapshots,
    }
    keys = {table: [key] for table, key in NATURAL_KEYS.items()}
    keys["event_corp_action"] = [["account_id", "action_id"], ["account_id", "transaction_id"]]
    keys["event_trade_fill"] = [*keys["event_trade_fill"], ["account_id", "source_raw_record_id"]]
    rules = quality.table_rules()
    return quality.combined(
        *(quality.row_rules(checked[table], table, rules[table]) for table in rules),
        *(quality.unique_rules(checked[table], table, keys[table]) for table in keys),
        quality.reference_rule(cash, "event_cashflow", "instrument_id", known.where("active"), "instrument_id"),
        quality.reference_rule(trades, "event_trade_fill", "instrument_id", known, "instrument_id"),
    )


# fallbacks and reports


def eod_mark(spark: SparkSession, folder: str) -> DataFrame:
    trades = star.first_trades(spark, folder, "l_returnflag").select(
        "account_id", "instrument_id", "report_date_local", "trade_timestamp_utc", "transaction_id", "source_raw_record_id", "price",
        F.when(F.col("fx_rate_to_base").isNotNull() & F.col("net_cash").isNotNull(), F.col("price") + 1).cast(text.MONEY).alias("close_price"), "side", "quantity",
    )
    trades = stored(trades, "trades")  # asked for, looked up and summed for the broker rows
    days = F.array(F.col("report_date_local"), F.last_day("report_date_local"), F.date_sub(F.last_day("report_date_local"), 31))
    asked = trades.select("account_id", "instrument_id", F.explode(F.array_distinct(days)).alias("report_date_local"))
    return fallback.eod_marks(asked, valuation_latest(spark, folder, _totals(trades)), trades)


def fx_fallback(spark: SparkSession, folder: str) -> DataFrame:
    trades = star.first_trades(spark, folder, "l_returnflag").select(
        "account_id", "ib_exec_id", "currency", "functional_currency", "report_date_local", "net_cash_in_base", "net_cash", "fx_rate_to_base"
    )
    trades = stored(trades, "trades")  # for the pairs and days asked for, and for the rows
    return fallback.execution_fx(trades, star.fx_raw(spark, folder))


def corp_action_class(spark: SparkSession, folder: str) -> DataFrame:
    classified = corporate.classify(star.corp_action_raw(spark, folder), F.col("description").isNotNull())
    return classified.select("source_raw_record_id", "reorg_code", "action_class", "requires_manual", "provisional")


def provisional_scope(spark: SparkSession, folder: str) -> DataFrame:
    classified = corporate.classify(star.corp_action_raw(spark, folder), F.col("description").isNotNull())
    resolved = classified.where(F.col("reorg_code") == "TC").select("manual_case_id").where(F.col("manual_case_id").isNotNull())
    scoped = corporate.apply_provisional(snapshot_daily(spark, folder), corporate.unresolved_by_instrument(classified, resolved))
    return scoped.select("account_id", "instrument_id", "provisional", "unresolved_case_count")


def pnl_by_instrument(spark: SparkSession, folder: str) -> DataFrame:
    return reports.pnl_by_instrument(snapshot_daily(spark, folder), star.instruments(spark, folder))


def pnl_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return reports.pnl_by_label(snapshot_daily(spark, folder), star.labels(spark, folder))


def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.group_summary(snapshot_daily(spark, folder), "account_id")


def label_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """A report whose labels lack some instruments against the full sums."""
    rows, labels = stored(snapshot_daily(spark, folder), "snapshot"), star.labels(spark, folder)
    report = reports.pnl_by_label(rows, labels.where(F.col("instrument_id").cast("int") % 7 != 0))
    return reports.label_rollup_gaps(rows, labels, report)


def recon_diff(spark: SparkSession, folder: str) -> DataFrame:
    held = _held(spark, folder)
    totals = _totals(held)
    broker_realized = held.groupBy("account_id", "instrument_id").agg(
        F.max("fees").alias("fees"), F.min("source_raw_record_id").alias("source_raw_record_id")
    )
    broker = broker_realized.join(
        valuation_latest(spark, folder, totals).select("account_id", "instrument_id", "position_qty", F.col("broker_unrealized_pnl").alias("unrealized_pnl")),
        ["account_id", "instrument_id"], "left",
    ).withColumn("report_date_local", F.lit(SNAPSHOT_DATE).cast("date"))
    metrics = ("unrealized_pnl", "fees", "withholding_tax", "position_qty")
    diff = reports.reconciliation_diff(stored(snapshot_daily(spark, folder, held, totals), "snapshot"), broker, metrics)
    return reports.diff_report(diff.withColumnRenamed("account_id", "a").drop("a"), star.instruments(spark, folder)).drop("source_event_id")


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    events = merge.merge_trades(None, star.trade_raw(spark, folder), TRADE_ORDER).select("account_id", "ib_exec_id", "source_raw_record_id", "ingestion_run_id")
    raw = tables_raw(spark, folder, "Trades")
    artifacts = raw.select("raw_artifact_id", "ingestion_run_id").groupBy("raw_artifact_id").agg(F.min("ingestion_run_id").alias("ingestion_run_id"))
    artifacts = artifacts.withColumn("payload_sha256", F.sha2("raw_artifact_id", 256))
    known = raw.select("ingestion_run_id").distinct().withColumn("status", F.lit("success"))
    chain = reports.provenance(events, raw, artifacts, known)
    return chain.select("account_id", "ib_exec_id", "source_raw_record_id", "source_row_ref", "raw_artifact_id", "payload_sha256", "artifact_run_id", "run_status")


def tables_raw(spark: SparkSession, folder: str, *sections: str) -> DataFrame:
    """Raw rows with the artifact (account and run) they came in."""
    raw = star.raw_records(spark, folder, with_payload=False).where(F.col("section_name").isin(*sections))
    return raw.withColumn("raw_artifact_id", F.concat_ws("/", "account_id", "ingestion_run_id"))


def report_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Every daily report row with the fills, closed lots and cash rows behind it, down to artifact and run."""
    cash = merged_cashflows(spark, folder)
    cash = cash.withColumns({"event_id": F.concat_ws("|", "transaction_id", "cash_action", "currency"), "source_raw_record_id": F.concat(F.lit("c"), "source_raw_record_id")})
    fills = stored(star.fills(spark, folder), "fills")
    cuts = _cuts(spark, folder)
    usage = reports.usage_of(fills, cuts)
    discard(fills)
    events = stored(reports.contributions(None, cash, cuts, usage), "contributions")
    discard(usage)
    raw = tables_raw(spark, folder, "Trades", "CashTransactions")
    artifacts = raw.groupBy("raw_artifact_id").agg(F.min("ingestion_run_id").alias("ingestion_run_id")).withColumn("payload_sha256", F.sha2("raw_artifact_id", 256))
    known = raw.select("ingestion_run_id").distinct().withColumn("status", F.lit("success"))
    chain = reports.lineage(None, events, raw, artifacts, known)
    return chain.select(
        "account_id", "instrument_id", "report_date_local", "role", "event_id", "source_raw_record_id", "quantity", "amount",
        "section_name", "source_row_ref", "raw_artifact_id", "artifact_run_id", "run_status",
    )


def drilldown(spark: SparkSession, folder: str) -> DataFrame:
    events = star.first_trades(spark, folder).select("account_id", "instrument_id", "ib_exec_id", "quantity", "side")
    found = reports.drilldown(star.labels(spark, folder), star.instruments(spark, folder), events)
    return found.groupBy("label_name", "symbol", "account_id").agg(F.count(F.lit(1)).alias("event_count"), F.sum("quantity").cast(text.MONEY).alias("quantity"))


def csv_contract(spark: SparkSession, folder: str) -> DataFrame:
    rows = pnl_by_instrument(spark, folder)
    export.check_columns(rows, export.BY_INSTRUMENT)
    return export.as_text(rows)


# streams


def _arrivals(df: DataFrame, day: str, ends: tuple[str, ...]) -> Iterator[DataFrame]:
    """A folder that gets the rows of one date range after the other; yields it as a stream
    after each arrival."""
    spark = df.sparkSession
    path, ready = scratch_path(spark, "feed"), scratch_path(spark, "arrivals")
    number = reduce(lambda n, last: n + F.coalesce(F.col(day) >= F.lit(last).cast("date"), F.lit(True)).cast("int"), ends, F.lit(0))
    filed = df.withColumn("_arrival", number)
    filed.write.partitionBy("_arrival").option("compression", CODEC).parquet(ready)  # made once, not again for each arrival
    made = spark.read.schema(filed.schema).parquet(ready)
    made.scratch = ready
    for arrival in range(len(ends) + 1):
        made.where(F.col("_arrival") == arrival).drop("_arrival").write.mode("append").option("compression", CODEC).parquet(path)
        if arrival == len(ends):
            discard(made)  # all of it is in the feed
        yield spark.readStream.schema(df.schema).parquet(path)


def _coming_again(fills: DataFrame, again: Column) -> DataFrame:
    """Fills, and some of them once more with the last arrival; they are made once for both."""
    last = F.lit("2100-01-01").cast("date")
    times = F.when(again, F.array("arrival", last)).otherwise(F.array("arrival"))
    return fills.withColumn("arrival", F.explode(times))


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Statements of all orders through the ingest job; raw rows by section and rejections by reason."""
    root = scratch_path(spark, "ledger")
    store = Store(spark, f"{root}/tables", buckets=8)
    payloads = star.statement_payloads(star.table_stream(spark, folder, "orders"))
    incremental.ingest_payload_stream(payloads, store, f"{root}/checkpoint", "stream", strict=False, require_sections=False)
    raw = store.read("raw_record", schemas.RAW_RECORD).groupBy(F.col("section_name").alias("name")).agg(F.count(F.lit(1)).alias("row_count"))
    bad = store.read("rejected_payload", jobs.REJECTED).groupBy(F.col("reason").alias("name")).agg(F.count(F.lit(1)).alias("row_count"))
    return raw.select(F.lit("raw").alias("kind"), "*").unionByName(bad.select(F.lit("rejected").alias("kind"), "*"))


_RUN_COLUMNS = (
    "run_id", "run_type", "status", "error_code", "rejected_count", "raw_record_count", "raw_deduplicated_count", "canonical_input_row_count",
    "canonical_violation_row_count", "instrument_upsert_count", "trade_fill_count", "cashflow_count", "fx_count", "corp_action_count", "canonical_skip_reason",
)


def _monthly(spark: SparkSession, folder: str) -> DataFrame:
    """The statements of all orders, filed by month."""
    payloads = star.statement_payloads(star.table(spark, folder, "orders"))
    monthly = payloads.withColumn("period_key", F.date_format(F.trunc("created_at_utc", "MM"), "yyyy-MM-dd"))
    return stored(statements.spread(monthly), "payloads")


def ingest_job(spark: SparkSession, folder: str) -> DataFrame:
    """Run records of three runs over all statements: a load, the same once more, and a strict one that lacks sections."""
    store = Store(spark, scratch_path(spark, "ledger"), buckets=8)
    payloads = _monthly(spark, folder)
    for run in (jobs.Run("load", strict=False, require_sections=False), jobs.Run("again", strict=False, require_sections=False), jobs.Run("strict", run_type="scheduled")):
        jobs.ingest(store, payloads, run)
    lists = (F.array_join(name, ",").alias(name) for name in ("missing_sections", "missing_hard_required"))
    return jobs.run_records(store).select(*_RUN_COLUMNS, *lists)


def reprocess_job(spark: SparkSession, folder: str) -> DataFrame:
    """Run records of a load and of a replay of its first account and month, and of a replay of no real month."""
    store = Store(spark, scratch_path(spark, "ledger"), buckets=8)
    jobs.ingest(store, _monthly(spark, folder), jobs.Run("load", strict=False, require_sections=False))
    raw = store.read("raw_record", schemas.RAW_RECORD)
    period, account = raw.agg(F.min(F.struct("period_key", "account_id"))).first()[0]
    jobs.reprocess(store, account, period, "q1", jobs.Run("replay", strict=False))
    jobs.reprocess(store, account, "1995-13-01", "q1", jobs.Run("no-month"))
    return jobs.run_records(store).select("account_id", *_RUN_COLUMNS)


def stream_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Cash rows month by month; repeated keys become corrections."""
    root = scratch_path(spark, "cash")
    store = Store(spark, f"{root}/tables", buckets=8)
    rule = lambda existing, batch: merge.merge_cashflows(existing, batch, CASH_ORDER)
    keys = NATURAL_KEYS["event_cashflow"]
    for feed in _arrivals(star.cashflow_raw(spark, folder), "effective_at_utc", ("2024-01-15", "2024-02-15")):
        incremental.merge_stream(feed, store, f"{root}/checkpoint", "event_cashflow", schemas.CASHFLOW, keys, rule)
    return store.read("event_cashflow", schemas.CASHFLOW)


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct events per user, type and day, arriving in order; state holds the keys of the last days only."""
    event = star.table(spark, folder, "events")
    day = F.to_date("ts")
    rows = event.select("user_id", "event_type", day.alias("day"), F.col("ts").cast("timestamp").alias("at"))
    path, keys = scratch_path(spark, "dedupe"), ["user_id", "event_type", "day"]
    for feed in _arrivals(rows, "day", ("2024-01-12", "2024-01-25", "2024-02-10")):
        incremental.distinct_stream(feed, keys, "at", "2 days", path)
    return spark.read.parquet(f"{path}/rows").select(*keys)


def stream_stage_window(spark: SparkSession, folder: str) -> DataFrame:
    event = star.table_stream(spark, folder, "events")
    rows = event.select(
        F.col("event_type").alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    path = scratch_path(spark, "windows")
    incremental.stage_windows(rows, "1 hour", "1 day", path)
    counts = incremental.read_stage_windows(spark, path)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "stage", "status", "event_count")


def stream_fifo(spark: SparkSession, folder: str) -> DataFrame:
    """Fills in four micro-batches through the incremental lot matcher."""
    root = scratch_path(spark, "fifo")
    store = Store(spark, f"{root}/tables", buckets=8)
    # some fills of the past come once more, with the last arrival
    again = (F.col("report_date_local") < F.lit("1999-01-01").cast("date")) & (F.pmod(F.xxhash64("fill_id"), F.lit(10)) == 0)
    fed = _coming_again(star.fills(spark, folder).withColumn("arrival", F.col("report_date_local")), again)
    for feed in _arrivals(fed, "arrival", ("1997-01-01", "1999-01-01", "2000-06-01")):
        incremental.fifo_stream(feed, store, f"{root}/checkpoint")
    realized = store.read("realized", incremental.REALIZED)
    lots = store.read("open_lot", incremental.FILL).groupBy("account_id", "instrument_id").agg(
        F.count(F.lit(1)).alias("open_lot_count"), F.sum("quantity").cast(text.MONEY).alias("open_quantity")
    )
    return realized.join(lots, ["account_id", "instrument_id"], "left").select(
        "account_id", "instrument_id", F.col("realized").cast(text.MONEY).alias("realized_pnl"), F.coalesce("open_lot_count", F.lit(0).cast("bigint")).alias("open_lot_count"),
        F.coalesce("open_quantity", F.lit(0)).cast(text.MONEY).alias("open_quantity"),
    )


def stream_fifo_state(spark: SparkSession, folder: str) -> DataFrame:
    """Fills in order of time through keyed state, with fees that don't divide; some fills come again with the last arrival."""
    path = scratch_path(spark, "lots")
    fills = star.uneven_fills(spark, folder).withColumn("arrival", F.to_date("trade_timestamp_utc"))
    again = (F.col("arrival") < F.lit("1997-01-01").cast("date")) & (F.pmod(F.xxhash64("fill_id"), F.lit(10)) == 0)
    for feed in _arrivals(_coming_again(fills, again), "arrival", ("1997-01-01", "1999-01-01", "2000-06-01")):
        lots.lot_stream(feed, path)
        state.compact(spark, path, lots.RESULT_KEYS, lots.OUT, keep=1)
    return lots.positions(spark, path).select("account_id", "instrument_id", F.col("realized").cast(text.MONEY).alias("realized_pnl"), "fill_count")


QUERIES = {
    f.__name__: f
    for f in (
        fifo_realized, fifo_realized_split, fifo_uneven_fees, fifo_position, fifo_open_lots, fifo_matches, fifo_matches_split, position_lots, lot_ids, last_price, fifo_unrealized_at_mark,
        open_cost_basis, fees_by_instrument, cash_totals, valuation_latest, snapshot_daily, snapshot_series, snapshot_series_split, snapshot_publish, snapshot_counters,
        trade_merge, cashflow_merge, fx_merge, corp_action_merge, instrument_merge, raw_dedupe_counts, artifact_dedupe,
        map_trades, map_cashflows, map_fx, map_corp_actions, map_violations, row_tag_route, batch_counters, resolved_events,
        xml_rows, xml_rejected, statement_files, statement_dates, required_sections,
        parse_dates, parse_timestamps, parse_decimals, optional_texts, business_date, business_date_range,
        snapshot_list, snapshot_json, run_state, run_list, run_filters, instrument_list, note_list, timeline_last_stage,
        missing_sections, canonical_details, error_codes, latest_run, slo_success_rate, slo_p95, retention_split, dq_rules,
        eod_mark, fx_fallback, corp_action_class, provisional_scope, pnl_by_instrument, pnl_by_label, group_summary, label_rollup,
        recon_diff, provenance, report_lineage, drilldown, csv_contract,
        ingest_job, reprocess_job, stream_ingest, stream_corrections, stream_dedupe, stream_stage_window, stream_fifo, stream_fifo_state,
    )
}
