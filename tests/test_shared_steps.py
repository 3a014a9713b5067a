from __future__ import annotations

import os
import time

import pytest
from conftest import SMALL

from pyspark.sql import functions as F

from tallystone import schemas
from tallystone.plans import catalog, jobs
from tallystone.plans.store import Store
from tallystone.session import discard, scratch_path, shared_dir, stored
from tallystone.sources import star, statements
from tallystone.streaming import incremental


def test_narrow_first_items_are_the_first_executions(spark):
    item = star.table(spark, SMALL, "lineitem")
    again = item.withColumn("l_shipdate", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_shipdate"))).withColumn("l_quantity", F.col("l_quantity") + 1)
    rows = item.unionByName(again).unionByName(item)  # ties in time, missing times and exact repeats
    want = star.first_executions(star.trade_raw(spark, SMALL, rows))
    got = star.trade_raw(spark, SMALL, star.first_items(rows, "l_returnflag")).select(*want.columns)
    assert want.count() == got.count() and want.exceptAll(got).isEmpty()


def test_line_items_are_shuffled_once_for_rates(spark):
    """Trades are stored for the days asked for and for the rows; each used to scan and order the items."""
    plan = catalog.fx_fallback(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_arrivals_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("date")
    def day(n):
        made.add(1)
        import datetime

        return datetime.date(2000, 1, 1 + n % 9)

    rows = spark.range(90).select("id", day("id").alias("day"))
    seen = [feed.schema for feed in catalog._arrivals(rows, "day", ("2000-01-03", "2000-01-06"))]
    assert len(seen) == 3 and made.value == 90


def test_rows_without_a_day_arrive_too(spark):
    """They were in no arrival."""
    rows = spark.range(9).select("id", F.when(F.col("id") % 3 != 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))).alias("day"))
    sizes = []
    for feed in catalog._arrivals(rows, "day", ("2000-01-03", "2000-01-06")):
        query = feed.writeStream.format("memory").queryName(f"arrived{len(sizes)}").trigger(availableNow=True).start()
        query.awaitTermination()
        sizes.append(spark.table(f"arrived{len(sizes)}").count())
    assert sizes == [1, 3, 9]


def test_raw_rows_are_written_once(spark, monkeypatch):
    """A run publishes its raw rows and maps them from there; there were two scratch copies more of them."""
    names = []
    monkeypatch.setattr(jobs, "stored", lambda df, name: names.append(name) or stored(df, name))
    store = Store(spark, scratch_path(spark, "ledger"), buckets=2)
    payloads = star.statement_payloads(star.table(spark, SMALL, "orders").limit(40))
    assert jobs.ingest(store, payloads, jobs.Run("load", strict=False, require_sections=False)) == "success"
    assert not {"new_raw", "raw"} & set(names) and "parsed" in names
    raw = store.read("raw_record", schemas.RAW_RECORD)
    assert raw.count() > 0 and raw.select("raw_record_id").distinct().count() == raw.count()


def test_a_section_is_mapped_without_the_others(spark):
    """A filter on the section's name leaves out the tables of the other sections; payloads of all were made for each."""
    plan = catalog.map_fx(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" in plan and "l_partkey" not in plan and "event_type" not in plan


def test_each_section_is_mapped_once_for_the_counters(spark, monkeypatch):
    names = []
    monkeypatch.setattr(catalog, "stored", lambda df, name: names.append(name) or stored(df, name))
    plan = catalog.batch_counters(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert names == [] and sum("l_partkey" in line and "Relation" in line for line in plan.splitlines()) == 1


@pytest.fixture
def small_tasks(spark):
    """A shuffle keeps its partitions, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_payloads_of_one_small_file_are_parsed_by_many_tasks(spark, small_tasks):
    """All statements of a row group of the table were parsed by one task, for their file is small."""
    assert len(catalog._monthly(spark, SMALL).inputFiles()) > 1


def test_a_payload_is_judged_once_for_all_outputs(spark, monkeypatch):
    payloads = star.statement_payloads(star.table(spark, SMALL, "orders").limit(60))
    plain = statements.parse_payloads(payloads)
    kept = statements.judged(plain)
    for output in (statements.good_rows, statements.rejected_payloads):
        want = output(plain)
        assert sorted(map(str, output(kept).select(*want.columns).collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(statements, "_fault", None)
    assert statements.good_rows(kept).count() > 0


def test_payloads_of_a_micro_batch_are_parsed_by_many_tasks(spark, small_tasks, monkeypatch):
    files = []
    monkeypatch.setattr(jobs, "ingest", lambda store, payloads, run: files.append(payloads.inputFiles()) or "success")
    feed = star.statement_payloads(star.table_stream(spark, SMALL, "orders"))
    incremental.ingest_payload_stream(feed, None, scratch_path(spark, "dealt"), "dealt")
    assert len(files[0]) > 1


def test_a_stored_copy_leaves_no_shuffle_files_and_can_be_discarded(spark):
    """Shuffle files of what was written stayed until the driver collected its garbage, those of all steps of a query together."""
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    rows = spark.range(20000).withColumn("h", F.md5(F.col("id").cast("string")))
    copy = stored(rows.groupBy("h").count(), "grouped")
    for _ in range(50):  # files go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert copy.count() == 20000
    discard(copy)
    assert not os.path.exists(copy.scratch)


def test_lineage_keeps_no_copy_it_does_not_read_and_joins_no_report(spark):
    before = set(os.listdir(shared_dir(spark)))
    plan = catalog.report_lineage(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before}
    assert "contributions" in left and not {"fills", "usage"} & left
    assert sum("Join" in line for line in plan.splitlines()) <= 3
