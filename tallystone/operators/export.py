"""Checked, versioned exports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions.text import MONEY

SCHEMA_VERSION = "v1"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = False


# Columns of the exports, in order.
BY_INSTRUMENT = (
    Field("report_date_local", "date"),
    Field("instrument_id", "string"),
    Field("conid", "string"),
    Field("symbol", "string"),
    Field("currency", "string"),
    Field("position_qty", MONEY),
    Field("cost_basis", MONEY, nullable=True),
    Field("realized_pnl", MONEY),
    Field("unrealized_pnl", MONEY),
    Field("total_pnl", MONEY),
    Field("provisional", "boolean"),
)
BY_LABEL = (
    Field("report_date_local", "date"),
    Field("label_id", "string"),
    Field("label_name", "string"),
    Field("instrument_count", "int"),
    Field("realized_pnl", MONEY),
    Field("unrealized_pnl", MONEY),
    Field("total_pnl", MONEY),
    Field("fees", MONEY),
    Field("withholding_tax", MONEY),
    Field("provisional", "boolean"),
)
RECONCILIATION_DIFF = (
    Field("report_date_local", "date"),
    Field("instrument_id", "string"),
    Field("conid", "string"),
    Field("symbol", "string"),
    Field("metric", "string"),
    Field("broker_value", MONEY, nullable=True),
    Field("economic_value", MONEY, nullable=True),
    Field("abs_diff", MONEY),
    Field("rel_diff", MONEY, nullable=True),
    Field("tolerance_abs", MONEY),
    Field("tolerance_rel", MONEY),
    Field("within_tolerance", "boolean"),
    Field("formula_context", "string", nullable=True),
    Field("source_event_id", "string", nullable=True),
    Field("source_raw_record_id", "string", nullable=True),
    Field("provisional", "boolean"),
)


class ExportContractError(ValueError):
    """The rows do not fit the export contract."""


def check_columns(df: DataFrame, contract: Sequence[Field]) -> None:
    """Names, order and types; fails before anything runs."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    want = [(f.name, f.kind) for f in contract]
    if have != want:
        raise ExportContractError(f"columns {have} do not fit contract {SCHEMA_VERSION} {want}")


def null_violations(df: DataFrame, contract: Sequence[Field]) -> DataFrame:
    """Nulls per column that must have none."""
    required = [f.name for f in contract if not f.nullable]
    counts = df.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name in required))
    pairs = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).alias("null_count")) for n in required))
    return counts.select(F.inline(pairs)).where(F.col("null_count") > 0)


def _text(df: DataFrame, name: str) -> Column:
    """ISO date or time, plain decimal, or the value as text."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(name)
    if isinstance(kind, T.DecimalType):
        return F.call_function("format_number", F.col(name), F.lit(f"0.{'0' * kind.scale}")).alias(name)
    return F.col(name).cast("string").alias(name)


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*(_text(df, name) for name in df.columns))


def as_json(df: DataFrame, name: str = "item") -> DataFrame:
    """Each row as one JSON text: decimals, dates and ids as texts, numbers and flags as they are, nulls kept."""
    plain = (T.BooleanType, T.IntegerType, T.LongType)
    fields = [F.col(f.name) if isinstance(f.dataType, plain) else _text(df, f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def write_csv(df: DataFrame, contract: Sequence[Field], path: str) -> None:
    """Check, then write headed CSV files below ``path``/<version>."""
    check_columns(df, contract)
    broken = null_violations(df, contract).collect()  # one row per required column at most
    if broken:
        raise ExportContractError(f"nulls in required columns: {[(r.column_name, r.null_count) for r in broken]}")
    as_text(df).write.option("header", True).csv(f"{path}/{SCHEMA_VERSION}")


def write_archive(archive: DataFrame, path: str) -> None:
    """Archived diagnostics as compressed JSON lines by month."""
    archive.write.partitionBy("archive_month").option("compression", "gzip").json(path)
