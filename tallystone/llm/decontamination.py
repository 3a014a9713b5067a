"""Benchmark decontamination as a prefix-filtered set join (native).

The windows of the benchmark items (ten words in a row; a shorter item is one window) are sets of
three-word shingles. Shingles are ordered by how often they stand in the documents. A text that
holds a window holds all its shingles, so the necessary prefix is one shingle: the rarest. The
documents' shingles are joined to these prefixes only; a match fixes where the window would start,
which must leave room for the whole window (length and positional bounds), and then the words
themselves are compared.

The benchmark's windows are numbered and broadcast in blocks of BLOCK rows of bounded width: one pass over the
documents per block, one block for any benchmark of usual size. Which items hold a window stays in a table of
its own, however many they are; it is joined to the distinct (document, window number) pairs. No document row
is shuffled before the match; what is matched is grouped by document.

Cases: a null or wordless text has no words and is clean; an item without words has no windows;
items without an id count as the item ''; repeated items are one; rows that repeat both id and
text are one document that is returned as often as it stands there. An empty benchmark hits
nothing. Other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import column, free_name
from tallystone.session import stored

WINDOW = 10
SHINGLE = 3
BLOCK = 100_000  # windows that are broadcast at a time

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _shingles(words: Column, k: int) -> Column:
    """Hashes of all k-word shingles, by place."""
    n = F.size(words) - (k - 1)
    rows = F.arrays_zip(*(F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)))
    return F.when(n > 0, F.transform(rows, lambda row: F.xxhash64(row))).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, number, window): distinct windows of each item, numbered by a hash of their words."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)))
    windows = items.where(n > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i, WINDOW))).alias("window"))
    return windows.select("item", F.xxhash64("window").alias("number"), "window").distinct()


def _places(docs: DataFrame, k: int) -> DataFrame:
    """One row per shingle of a document, with the document's words at hand."""
    # explode() of the one array, and the outer form below, keep the optimizer from moving filters
    # beneath: there they would split the text again for every use of its words
    words = docs.select("id", "h", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    return words.withColumn("hashes", _shingles(F.col("words"), k)).select("id", "h", "words", F.posexplode_outer("hashes").alias("at", "token"))


def distinct_windows(of_items: DataFrame) -> DataFrame:
    """(number, window, k): windows and the shingle length that fits them, one row each."""
    return of_items.select("number", "window").distinct().withColumn("k", F.least(F.size("window"), F.lit(SHINGLE)))


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, h, start, window, number): each place where one of the distinct windows stands in a document."""
    sizes = {r["k"]: r["n"] for r in windows.groupBy("k").agg(F.count("k").alias("n")).collect()}
    blocks = [(k, b, -(-n // BLOCK)) for k, n in sorted(sizes.items()) for b in range(-(-n // BLOCK))]
    found = []
    for k, block, of in blocks:
        part = windows.where((F.col("k") == k) & (F.pmod("number", F.lit(of)) == block))
        tokens = part.select("number", "window", F.posexplode(_shingles(F.col("window"), k)).alias("offset", "token"))
        frequency = (
            _places(docs, k).join(F.broadcast(tokens.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("token").alias("n"))
        )
        # a shingle that stands nowhere rules its window out: it has no row here, and is the rarest
        rarity = F.struct(F.coalesce(F.col("n"), F.lit(0)).alias("n"), "offset", "token")
        ranked = tokens.join(stored(frequency, "frequency"), "token", "left").groupBy("number", "window").agg(F.min(rarity).alias("r"))
        prefix = ranked.where("r.n > 0").select("number", "window", F.col("r.offset").alias("offset"), F.col("r.token").alias("token"))
        start, length = F.col("at") - F.col("offset"), F.size("window")
        fits = (start >= 0) & (start + length <= F.size("words"))
        matched = _places(docs, k).join(F.broadcast(prefix), "token").where(fits)
        same = F.slice(F.col("words"), F.greatest(start, F.lit(0)) + 1, length) == F.col("window")
        found.append(matched.where(same).select("id", "h", start.alias("start"), "window", "number"))
    if not found:
        nothing = "id bigint, h bigint, start int, window array<string>, number bigint"
        return docs.sparkSession.createDataFrame([], nothing)
    return reduce(DataFrame.unionByName, found)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, h, n_hit, found): documents with a window in them."""
    of_items = stored(item_windows(benchmark), "windows")
    found = stored(occurrences(_keyed(docs), stored(distinct_windows(of_items), "distinct_windows")), "found")
    spans = found.groupBy("id", "h").agg(F.collect_set(F.struct("start", F.size("window").alias("length"))).alias("spans"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    hit = spans.select("id", "h", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    # a number stands for one window but for a clash of hashes, which the words settle
    pairs = found.select("id", "h", "number", "window").distinct().join(of_items, ["number", "window"])
    items = pairs.groupBy("id", "h").agg(F.sort_array(F.collect_set("item")).alias("found"))
    same = F.col("x.id").eqNullSafe(F.col("y.id")) & (F.col("x.h") == F.col("y.h"))
    return hit.alias("x").join(items.alias("y"), same).select("x.id", "x.h", "n_hit", "found")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, per row of ``docs``."""
    base = _keyed(docs).select("id", "h", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).alias("b")
    hits = _hits(docs, benchmark).alias("r")
    joined = base.join(hits, F.col("b.id").eqNullSafe(F.col("r.id")) & (F.col("b.h") == F.col("r.h")), "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        F.col("b.id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no window of the benchmark, with all their columns."""
    names = [free_name(docs, n) for n in ("_id", "_h")]
    hits = _hits(docs.select(column(docs, "doc_id"), column(docs, "text")), benchmark).select("id", "h").toDF(*names).alias("r")
    keyed = docs.alias("b")
    same = F.col("b.doc_id").eqNullSafe(F.col(f"r.{names[0]}")) & (F.xxhash64("b.text") == F.col(f"r.{names[1]}"))
    return keyed.join(hits, same, "left_anti")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS win, least(len(w), 10) AS n FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i : array_to_string(w[i : i + n - 1], ' '))) AS win FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
hit AS (SELECT p.r, p.i, v.item, v.n FROM p JOIN v USING (win, n)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(found, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
