"""URL filters by a sort-merge range join.

A rule is a host and a path prefix. Under keys of reversed hosts (``org.example`` and then the path)
the urls that fit a rule on their own host are one interval of the sorted keys. A url is entered
under its host and each parent domain, so a rule that holds for subdomains is an interval too. Urls
and rules are sorted together by range; a sweep over each range keeps the stack of rules whose
interval is open, which are nested, and its top is the longest rule at that key. Of a url's
entries the longest rule wins.

Ranges are split by url as well as by key, so one host or one url may hold any share of the rows.
Rules that are open where a range begins are prefixes of its first key: they are looked up by these
prefixes, one row per range and letter of its first key.

Longest: most labels and letters of host and path together; of equal rules (or a tie of a longer
host with a shorter path) the longer path, then block. Cases: a null url, or one without ``://``, has
empty host and path, fits no rule and gets the default verdict; an empty path fits rules of an empty
path (whole hosts) only; hosts keep ports and user parts; rules with a null host, path or verdict are left out;
repeated rows of pages are judged one by one; an empty rule table gives every url the default.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import held, small_batches
from tallystone.session import stored

#: The rules of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "/", 1)).otherwise("")
    return F.translate(F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    whole = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    return F.when(F.instr(whole, "/") > 0, F.substr(whole, F.instr(whole, "/"))).otherwise("")


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels, a sign that sorts below all others, and the path: no host's key is a prefix
    of another host's."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("\x00"), path)


def _sweep(batches: Iterator[pd.DataFrame], open_at: dict[int, list]) -> Iterator[pd.DataFrame]:
    """Rows in order of key, rules before urls. A rule leaves the stack where its interval ends."""
    stack: list[tuple[str, str]] = list(open_at.get(TaskContext.get().partitionId(), ()))
    for batch in batches:
        out = []
        for key, row, rule in zip(batch["key"], batch["row"], batch["rule"]):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1][0] != key:  # equal rules come in order of rank
                    stack.append((key, rule))
            elif stack:
                out.append((row, *stack[-1]))
        yield pd.DataFrame(out, columns=["row", "found", "rule"])


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule (null: none) and verdict for every row of ``pages``."""
    spark = pages.sparkSession
    small_batches(spark, 10_000)
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = stored(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", "\\.")
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    name = F.concat("host", "path")
    ruled = known.select(
        _key(labels, F.col("path")).alias("key"),
        F.lit(None).cast("long").alias("row"),
        F.concat(F.col("verdict"), F.lit(" "), name).alias("rule"),
        (F.col("verdict") != "block").cast("int").alias("rank"),
    )
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.slice(labels, i, F.size(labels)))
    entries = urls.where("host != ''").select("row", "path", F.explode(parents).alias("parent"))
    asked = entries.select(_key(F.col("parent"), F.col("path")).alias("key"), "row", F.lit(None).cast("string").alias("rule"), F.lit(2).alias("rank"))
    order = ["key", "rank", "row", "rule"]
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = asked.unionByName(ruled).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the ranges must be the same for both uses below
    ordered = held(ordered.withColumn("range", F.spark_partition_id()))
    firsts = ordered.groupBy("range").agg(F.min("key").alias("key"))
    starts = firsts.select("range", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substr("key", F.lit(1), n))).alias("key"))
    inherited = ordered.where("rule is not null").select(F.col("range").alias("at"), "key", "rule", "rank").join(starts, "key").where("at < range")
    # at most one rule per range and letter of its first key
    top = inherited.groupBy("range", "key").agg(F.min_by("rule", F.struct("rank", "rule")).alias("rule"))
    open_at: dict[int, list] = {}
    for r in top.orderBy("range", F.length("key")).collect():
        open_at.setdefault(r["range"], []).append((r["key"], r["rule"]))
    found = ordered.select("key", "row", "rule").mapInPandas(lambda b: _sweep(b, open_at), "row long, found string, rule string")
    parts = F.struct(
        F.length(F.substring_index("rule", " ", -1)).alias("length"),
        F.length(F.substring_index("found", "\x00", -1)).alias("path"),
        F.substring_index("rule", " ", -1).alias("rule"),
        F.substring_index("rule", " ", 1).alias("verdict"),
    )
    best = found.groupBy("row").agg(F.max(parts).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
best AS (SELECT u.r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(rules.verdict, length(rules.host || rules.path)) AS verdict
         FROM u JOIN rules ON (u.host = rules.host OR ends_with(u.host, '.' || rules.host)) AND starts_with(u.path, rules.path) GROUP BY u.r)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM u LEFT JOIN best USING (r)
"""
