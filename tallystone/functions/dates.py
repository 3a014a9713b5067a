"""Date and time columns. Instants are ``timestamp_ntz`` holding UTC wall time, so
no result depends on the session time zone.

Parsing rewrites a text step by step into one canonical form and casts once, so each
step reads the text a single time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.text import trimmed

BUSINESS_ZONE = "Asia/Jerusalem"

# Fixed values of the statement format.
ZONE_OFFSETS = {"EST": "-0500", "EDT": "-0400"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# A date may be followed by a separator and anything.
_TAIL = r"(?:[;T ].*)?$"
_HOUR, _SIXTY = r"(?:[01]\d|2[0-3])", r"[0-5]\d"
_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)"
_CLOCK = rf"(?:{_HOUR}(?::{_SIXTY}(?::{_SIXTY}(?:[.,]\d+)?)?)?|{_HOUR}{_SIXTY}(?:{_SIXTY}(?:[.,]\d+)?)?){_OFFSET}?$"

# Written date forms and their place in year-month-day. Two-digit years 69-99 are 1969-1999.
_DATE_FORMS = (
    (rf"(?s)^(\d{{4}})([-/])(\d{{1,2}})\2(\d{{1,2}}){_TAIL}", "$1-$3-$4"),
    (rf"(?s)^(\d{{4}})(\d{{2}})(\d{{2}}){_TAIL}", "$1-$2-$3"),
    (rf"^(\d{{4}})(-?)(\d{{2}})\2(\d{{2}})(?:[,;]\s*|.){_CLOCK}", "$1-$3-$4"),
    (rf"(?s)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_TAIL}", "$3-$1-$2"),
    (rf"(?s)^(\d{{1,2}})/(\d{{1,2}})/(69|[7-9]\d){_TAIL}", "19$3-$1-$2"),
    (rf"(?s)^(\d{{1,2}})/(\d{{1,2}})/(\d{{2}}){_TAIL}", "20$3-$1-$2"),
)
_CANONICAL_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_NAMED_DATE = r"(?s)^(\d{1,2})-([A-Za-z]{3})-(\d{2})(?:[; ].*|(?<![A-Z]T-\d\d)T.*)?$"

# Year, month, day, hour, minute, second, fraction and offset are groups 1, 3-9.
_ISO_INSTANT = (
    rf"^(\d{{4}})(-?)(\d{{2}})\2(\d{{2}})(?:(?:[;,]\s*|.)(?={_CLOCK})"
    rf"(\d{{2}})(?::?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,6}})\d*)?)?)?({_OFFSET})?)?$"
)
_NAMED_ZONE = r"^\d{1,2}\s+[A-Za-z]+,\s+\d{4}\s+(?:0?[1-9]|1[0-2]):\d{1,2}\s+[AaPp][Mm]\s+(?:EST|EDT)$"


def _named_date(text: Column) -> Column:
    """``14-Feb-26``."""
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, _NAMED_DATE, 2)))
    year = F.regexp_extract(text, _NAMED_DATE, 3)
    century = F.when(year >= "69", "19").otherwise("20")
    written = F.concat(century, year, F.lit("-"), month.cast("string"), F.lit("-"), F.regexp_extract(text, _NAMED_DATE, 1))
    return F.when(text.rlike(_NAMED_DATE), written.try_cast("date"))


def local_date(value: Column) -> Column:
    """Date from any of the supported forms, alone or before ``;``, ``T`` or a space; null when none fits."""
    text = trimmed(value)
    written = text
    for form, place in _DATE_FORMS:
        written = F.regexp_replace(written, form, place)
    return F.coalesce(F.regexp_extract(written, _CANONICAL_DATE, 0).try_cast("date"), _named_date(text))


def _utc(instant: Column) -> Column:
    """UTC wall time of a ``timestamp``."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(6,6)")
    none = F.lit(0)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds.cast("decimal(18,6)"))


def utc_instant(value: Column) -> Column:
    """UTC instant from an ISO date or date-time with any one separator (no offset means
    UTC), or from ``20 February, 2026 02:15 PM EST``; null when neither fits."""
    text = trimmed(value)
    written = F.regexp_replace(text, _ISO_INSTANT, "$1-$3-$4T$5:$6:$7.$8|$9")
    for gap, filled in (("T:", "T00:"), ("::", ":00:"), (":.", ":00."), (".|", ".0|")):
        written = F.replace(written, F.lit(gap), F.lit(filled))
    written = F.replace(F.regexp_replace(written, r"\|$", "Z"), F.lit("|"), F.lit(""))
    iso = F.when(text.rlike(_ISO_INSTANT), written.try_cast("timestamp"))
    spoken = F.regexp_replace(text, r"\s+", " ")
    for zone, offset in ZONE_OFFSETS.items():
        spoken = F.regexp_replace(spoken, f"{zone}$", offset)
    named = F.when(text.rlike(_NAMED_ZONE), F.try_to_timestamp(spoken, F.lit("d MMMM, yyyy h:m a xx")))
    return _utc(F.coalesce(iso, named))


def business_date(instant: Column) -> Column:
    """Calendar date of a UTC instant where the business is."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(BUSINESS_ZONE), instant))


def business_day_start(day: Column) -> Column:
    """UTC instant at which a business date starts."""
    return F.convert_timezone(F.lit(BUSINESS_ZONE), F.lit("UTC"), day.cast("timestamp_ntz"))


def mixed_date(value: Column) -> Column:
    """``YYYYMMDD`` when eight characters long, else an ISO date; blank is null."""
    dashed = F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2))
    return F.when(F.length(value) == 8, dashed.try_cast("date")).otherwise(F.nullif(value, F.lit("")).try_cast("date"))


def period_key(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd")


def is_period_key(value: Column) -> Column:
    """Whether a text is a real ``YYYY-MM-DD`` date."""
    text = trimmed(value)
    return F.coalesce(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & text.try_cast("date").isNotNull(), F.lit(False))
