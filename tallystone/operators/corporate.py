"""Which corporate actions need a person, and whom that makes provisional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action codes handled without a person when the row states an unambiguous
# ratio or amount. Everything else is manual.
AUTO_IF_UNAMBIGUOUS_CODES = ("FS", "RS", "SD", "CD")

AUTO_IF_UNAMBIGUOUS, MANUAL = "auto_if_unambiguous", "manual"


def action_class(code: Column) -> Column:
    return F.when(F.upper(F.trim(code)).isin(*AUTO_IF_UNAMBIGUOUS_CODES), AUTO_IF_UNAMBIGUOUS).otherwise(MANUAL)


def classify(actions: DataFrame, unambiguous: Column | None = None) -> DataFrame:
    """Add the class of each action and whether it needs a person.

    ``unambiguous`` tells for a row whether its ratio or amount is explicit; without it
    actions of the middle class are taken as ambiguous."""
    kind = action_class(F.col("reorg_code"))
    clear = F.lit(False) if unambiguous is None else F.coalesce(unambiguous, F.lit(False))
    manual = (kind == MANUAL) | ((kind == AUTO_IF_UNAMBIGUOUS) & ~clear) | F.col("requires_manual")
    return actions.withColumns({"action_class": kind, "requires_manual": manual, "provisional": manual | F.col("provisional")})


def unresolved_by_instrument(classified: DataFrame, resolved_cases: DataFrame | None = None) -> DataFrame:
    """Open manual cases per (account, instrument)."""
    open_cases = classified.where(F.col("requires_manual") & F.col("instrument_id").isNotNull())
    if resolved_cases is not None:
        open_cases = open_cases.join(resolved_cases.select("manual_case_id").distinct(), "manual_case_id", "left_anti")
    return open_cases.groupBy("account_id", "instrument_id").agg(F.count(F.lit(1)).alias("unresolved_case_count"))


def apply_provisional(snapshot: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Mark rows of affected instruments only."""
    joined = snapshot.join(unresolved, ["account_id", "instrument_id"], "left")
    cases = F.coalesce("unresolved_case_count", F.lit(0).cast("bigint"))
    return joined.withColumns({"unresolved_case_count": cases, "provisional": F.col("provisional") | (cases > 0)})
