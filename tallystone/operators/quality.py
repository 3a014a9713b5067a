"""Integrity rules of the tables as one report: table, rule, violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UNIT_LIMIT = 9_999_999_999

RUN_STATUSES = ("started", "success", "failed")
RUN_TYPES = ("scheduled", "manual", "reprocess")
SIDES = ("BUY", "SELL")
LOT_STATUSES = ("open", "closed")


@dataclass(frozen=True)
class Rule:
    """``holds`` must not be false or null for any row."""

    name: str
    holds: Column


def one_of(column: str, values: Sequence[str]) -> Rule:
    return Rule(f"{column}_allowed", F.col(column).isin(*values))


def not_blank(column: str) -> Rule:
    return Rule(f"{column}_not_blank", F.trim(column) != "")


def is_uuid(column: str) -> Rule:
    return Rule(f"{column}_is_uuid", F.col(column).rlike(UUID_PATTERN))


def is_iso_date(column: str) -> Rule:
    return Rule(f"{column}_is_date", F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.col(column).try_cast("date").isNotNull())


def at_least_one(*columns: str) -> Rule:
    return Rule("_or_".join(columns) + "_present", F.coalesce(*columns).isNotNull())


def not_negative(column: str) -> Rule:
    return Rule(f"{column}_not_negative", F.col(column) >= 0)


def within_unit_range(column: str) -> Rule:
    """Quantities and prices of a usual size; larger ones are matched all the same."""
    return Rule(f"{column}_in_range", F.abs(column) <= UNIT_LIMIT)


def table_rules() -> dict[str, tuple[Rule, ...]]:
    """Row rules of each table."""
    return {
        "ingestion_run": (one_of("status", RUN_STATUSES), one_of("run_type", RUN_TYPES)),
        "raw_artifact": (not_blank("account_id"), is_iso_date("period_key"), not_blank("flex_query_id"), not_blank("payload_sha256")),
        "raw_record": (not_blank("section_name"), not_blank("source_row_ref")),
        "instrument": (not_blank("account_id"), not_blank("conid"), not_blank("asset_category"), not_blank("currency")),
        "event_trade_fill": (
            one_of("side", SIDES), not_blank("account_id"), not_blank("ib_exec_id"),
            within_unit_range("quantity"), within_unit_range("price"),
        ),
        "event_cashflow": (not_blank("account_id"), not_blank("transaction_id"), not_blank("cash_action"), not_blank("currency")),
        "event_fx": (not_blank("account_id"), not_blank("transaction_id"), not_blank("currency"), not_blank("functional_currency")),
        "event_corp_action": (at_least_one("action_id", "transaction_id"),),
        "position_lot": (one_of("status", LOT_STATUSES), not_negative("remaining_quantity"), is_uuid("position_lot_id")),
        "note": (at_least_one("instrument_id", "label_id"),),
    }


def _report(df: DataFrame, table: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), "rule", "violation_count")


def row_rules(df: DataFrame, table: str, rules: Sequence[Rule]) -> DataFrame:
    """All row rules of a table in one scan."""
    counts = df.agg(*(F.count_if(~F.coalesce(rule.holds, F.lit(False))).alias(rule.name) for rule in rules))
    pairs = F.array(*(F.struct(F.lit(rule.name).alias("rule"), F.col(rule.name).alias("violation_count")) for rule in rules))
    return _report(counts.select(F.inline(pairs)), table)


def unique_rule(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """How many rows are one too many for their key; keys with a null are not compared."""
    known = df
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    surplus = known.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_surplus"))
    total = surplus.agg(F.coalesce(F.sum("_surplus"), F.lit(0)).alias("violation_count"))
    return _report(total.withColumn("rule", F.lit("unique_" + "_".join(keys))), table)


def unique_rules(df: DataFrame, table: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """``unique_rule`` of several keys of a table at once: one grouping set per key, one shuffle for all."""
    names = list(dict.fromkeys(name for key in keys for name in key))
    by_set = df.select(*names).groupingSets([list(key) for key in keys], *names).agg(F.count(F.lit(1)).alias("_rows"), *(F.grouping(name).alias(f"_{name}") for name in names))
    number = F.lit(None).cast("int")
    for i, key in reversed(list(enumerate(keys))):
        here = F.lit(True)
        for name in names:
            here &= F.col(f"_{name}") == (0 if name in key else 1)
        number = F.when(here, i).otherwise(number)
    known = F.lit(True)
    for name in names:
        known &= (F.col(f"_{name}") == 1) | F.col(name).isNotNull()
    surplus = by_set.where(known).groupBy(number.alias("i")).agg(F.sum(F.col("_rows") - 1).alias("found"))
    rules = F.array(*(F.struct(F.lit(i).alias("i"), F.lit("unique_" + "_".join(key)).alias("rule")) for i, key in enumerate(keys)))
    every = df.sparkSession.range(1).select(F.inline(rules))
    total = every.join(surplus, "i", "left").select("rule", F.coalesce("found", F.lit(0).cast("bigint")).alias("violation_count"))
    return _report(total, table)


def reference_rule(df: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference is missing in the parent. Counted per distinct value first, so one
    value that most rows share is one row in the join."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    orphans = values.join(parent.select(F.col(parent_column).alias("_key")).distinct(), "_key", "left_anti")
    total = orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violation_count"))
    return _report(total.withColumn("rule", F.lit(f"{column}_exists")), table)


def combined(*reports: DataFrame) -> DataFrame:
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result
