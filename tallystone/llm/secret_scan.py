"""Secret scans with corpus-wide ownership frequency (native).

Three base patterns give the sure spans. Besides, every long token of mixed letters and digits is a
candidate, and so is the value of every base span. Candidates are hashed and counted over the
corpus by distinct owner (``source``) and distinct repository (``doc_id``). Equal texts of an owner are one
repository; the same text under several owners has them all. A value of several owners is a copied example, unless
nearly all of its repositories belong to one of them; such a value and one with a single owner look live, in
however many repositories. Live tokens that no base span touches are added as spans of kind ``live``; base spans stay in
any case and are counted as live or copied.

Places come from splitting a text at its matches: the lengths of the parts between and of the
matches add up to the offsets, in code points. Counting is by distinct (value, text), (value, owner,
repository), then (value, owner), then value, each combining map-side, so a value that is everywhere is a few
rows per task.

Cases: a null text is empty; a null source is one owner, a null id one repository; rows that repeat
id and text are counted once and returned as often as they stand there; matches that fail the length
test are dropped but consume their text, as in the contract. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.session import stored

#: Base kinds in their order, pattern (Java), group that must be long, its least length.
BASE = (
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the method: runs of such signs, with letters and digits.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
MIXED = ("[A-Za-z]", "[0-9]")
MAX_OWNERS = 1
#: With more owners than that, a value is still owner-specific if one of them has this share of its repositories.
OWNER_SHARE = 0.9

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All matches of a pattern that pass the length test, with code point offsets."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.arrays_zip(F.split(text, pattern).alias("before"), whole.alias("whole"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["before"])
        end = begin + F.length(piece["whole"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), piece["value"].alias("value"))
        keep = F.length(piece["value"]) >= least
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(keep, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    spans = F.aggregate(pieces, start, add, lambda state: state["found"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, h, source, base, tokens): the base spans and the method's candidates of each row."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    base = F.sort_array(F.concat(*(_spans(F.col("text"), k, *kind) for k, kind in enumerate(BASE))))
    tokens = _spans(F.col("text"), len(BASE), "live", TOKEN, 0, 20)
    mixed = F.filter(tokens, lambda t: reduce(Column.__and__, [t["value"].rlike(p) for p in MIXED]))
    # explode() of one struct keeps filters from being pushed below and scanning again
    both = F.explode(F.array(F.struct(base.alias("base"), mixed.alias("tokens")))).alias("s")
    found = rows.select("doc_id", "h", "source", both).select("doc_id", "h", "source", "s.*")
    apart = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    return found.withColumn("tokens", F.filter("tokens", apart))


def ownership(candidates: DataFrame) -> DataFrame:
    """(v, owners, repositories, largest) for rows (v, h, source, doc_id), one per place: how many owners a value has, in how
    many repositories it stands, and in how many of the owner that has most of them."""
    owner = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    by_text = candidates.groupBy("v", owner.alias("owner"), "h").agg(F.min("doc_id").alias("doc_id"))
    by_repository = by_text.groupBy("v", "owner", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = by_repository.groupBy("v", "owner").agg(F.count("one").alias("n"))
    return by_owner.groupBy("v").agg(F.count("owner").alias("owners"), F.sum("n").alias("repositories"), F.max("n").alias("largest"))


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def judged(docs: DataFrame, max_owners: int = MAX_OWNERS, owner_share: float = OWNER_SHARE) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and how many base values look live
    (few owners) or copied."""
    rows = stored(scanned(docs), "scanned")  # texts are scanned once
    places = rows.select("doc_id", "h", "source", F.explode(F.concat("base", "tokens")).alias("span")).withColumn("v", F.xxhash64("span.value"))
    owned = ownership(places.select("v", "h", "source", "doc_id"))
    live = (F.col("owners") <= max_owners) | (F.col("largest") >= F.lit(owner_share) * F.col("repositories"))
    verdicts = places.select("doc_id", "h", "span", "v").distinct().join(owned.select("v", live.alias("live")), "v")
    own = F.col("span.rank") == len(BASE)
    by_document = verdicts.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_list(F.when(own & F.col("live"), F.col("span")))).alias("added"),
        F.count_if(~own & F.col("live")).alias("n_live"),
        F.count_if(~own & ~F.col("live")).alias("n_copied"),
    )
    b, r = rows.select("doc_id", "h", "base").alias("b"), by_document.alias("r")
    joined = b.join(r, F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.h") == F.col("r.h")), "left")
    base = F.col("base")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    every = F.sort_array(F.concat(base, F.coalesce("added", F.array().cast(SPAN))))
    return joined.select(
        F.col("b.doc_id").alias("doc_id"),
        *(count(kind[0]).alias(f"n_{kind[0]}") for kind in BASE),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
