"""Ranked lexical search, hybrid of term-at-a-time and document-at-a-time.

Documents are split into terms once; what queries can ask for is stored as blocks of postings, so
searching reads no text. Over a block, the short lists of a query are added up term by term into one
array of accumulators; that array is from then on one more bounded iterator beside the long lists. Document
ranges are gone through in order: iterators whose bounds together stay below the k-th best score so
far propose nothing; what the others propose is looked up in them, from the largest bound down, only
while it can still reach that score. A task carries the best rows of each query from block to
block, so whole blocks are passed over by their bounds. Tasks hand on k rows a query.

Scores are integers: a term's weight is floor(1000 ln((2N+2)/(2df+1))), a document's norm
m = 75 + 25 n N div L, and a term adds weight * (10^9 tf div (1000 tf + 12 m)).

Queries are taken in blocks of at most ``QUERY_CHARS`` letters, each a pass over the documents, so what
goes to all tasks is bounded; an item longer than that is a block of its own.

Cases: a null text has no terms, a document without terms counts nowhere; null ids come first among
equal scores; rows that repeat an id are documents of their own, repeated items are ranked each for
themselves; an item without terms, or of terms that no document holds, has no rows; empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import small_batches
from tallystone.session import stored

K = 20
QUERY_CHARS = 4_000_000
#: A list is short when it holds at most this share of a block's documents.
SHORT = 8
#: Documents looked at together between two updates of the score to beat.
RANGE = 256

#: Letters and digits stay (A-Z lower-cased), and so does all that is not ASCII; the rest parts terms.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SIGNS).split()


_BLOCK = "ids array<bigint>, lengths binary, term array<int>, df array<int>, docs binary, tfs binary, n_docs bigint, n_terms bigint"


def _posted(vocabulary: dict[bytes, int]):
    """Blocks of postings of a vocabulary, one per batch of documents, in order of ids."""

    def block(ids: list[int | None], texts: list[str | None]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        lengths, found = np.zeros(len(ids), np.int64), []
        for at, i in enumerate(order):
            words = terms(texts[i])
            lengths[at] = len(words)
            counts = Counter(map(vocabulary.get, words))
            counts.pop(None, None)
            if counts:
                found.append(np.array([(t, at, tf) for t, tf in counts.items()], np.int64))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        term, df = np.unique(rows[:, 0], return_counts=True)
        row = {
            "ids": [ids[i] for i in order], "lengths": lengths.tobytes(), "term": term.astype(np.int32), "df": df.astype(np.int32),
            "docs": rows[:, 1].astype(np.int32).tobytes(), "tfs": rows[:, 2].astype(np.int64).tobytes(),
            "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
        }
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds)], names=list(row))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield block(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    return blocks


class _Best:
    """The k best rows of a query so far: by score, then null ids, then ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.known, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document must reach to be looked at."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least()
        if not good.any():
            return
        scores, known, ids = (np.concatenate(x) for x in ((self.scores, scores[good]), (self.known, known[good]), (self.ids, ids[good])))
        first = np.lexsort((ids, known, -scores))[: self.k]
        self.scores, self.known, self.ids = scores[first], known[first], ids[first]


#: An iterator over documents: their places in order, what each would add, and the most that any adds.
Postings = tuple[np.ndarray, np.ndarray, int]


def _accumulated(lists: list[Postings], size: int) -> list[Postings]:
    """The short lists summed term by term into one iterator, and the long ones as they are."""
    short = [x for x in lists if len(x[0]) * SHORT <= size]
    if len(short) < 2:
        return lists
    sums = np.zeros(size, np.int64)
    for docs, scores, _ in short:
        sums[docs] += scores
    docs = np.flatnonzero(sums)
    return [x for x in lists if len(x[0]) * SHORT > size] + [(docs, sums[docs], int(sums.max()))]


def _ranked(lists: list[Postings], known: np.ndarray, ids: np.ndarray, best: _Best) -> None:
    """Add a block's documents to the best rows of a query."""
    size = len(ids)
    order = sorted(_accumulated(lists, size), key=lambda x: x[2])
    together = list(accumulate(x[2] for x in order))
    for low in range(0, size, RANGE):
        least = best.least()
        first = bisect_left(together, least)  # the iterators before it can't reach ``least`` even together
        if first == len(order):
            return
        high = min(low + RANGE, size)
        sums, proposed = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for docs, scores, _ in order[first:]:
            a, b = docs.searchsorted((low, high))
            sums[docs[a:b] - low] += scores[a:b]
            proposed[docs[a:b] - low] = True
        found = np.flatnonzero(proposed)
        score, found = sums[found], found + low
        for i in range(first - 1, -1, -1):
            alive = score + together[i] >= least
            score, found = score[alive], found[alive]
            if not len(found):
                break
            docs, scores, _ = order[i]
            at = np.minimum(docs.searchsorted(found), len(docs) - 1)
            score = score + np.where(docs[at] == found, scores[at], 0)
        best.add(score, known[found], ids[found])


def _searched(queries: list[list[tuple[int, int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The k best documents of each query, (term, repeats) pairs, among the blocks of a task."""
    wanted = np.array([t for q in queries for t, _ in q], np.int64)
    repeats = np.array([r for q in queries for _, r in q], np.int64)
    starts = np.cumsum([0] + [len(q) for q in queries])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in queries]
        for batch in batches:
            for row in batch.to_pylist():
                if row["term"]:
                    one(row, best)
        q = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        scores, known, ids = (np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0) for name in ("scores", "known", "ids"))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64(), mask=~known.astype(bool))], names=["q", "score", "doc_id"])

    def one(row: dict, best: list[_Best]) -> None:
        term, df = np.array(row["term"], np.int64), np.array(row["df"], np.int64)
        docs, tfs = np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int64)
        norm = 75 + 25 * np.frombuffer(row["lengths"], np.int64) * n_docs // n_terms
        known = np.array([i is not None for i in row["ids"]], bool)
        ids = np.array([i or 0 for i in row["ids"]], np.int64)
        adds = np.repeat(weights[term], df) * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * norm[docs]))
        ends = np.cumsum(df)
        most = np.maximum.reduceat(adds, ends - df)
        at = np.minimum(term.searchsorted(wanted), len(term) - 1)
        here = term[at] == wanted
        bounds = np.concatenate([[0], np.cumsum(np.where(here, most[at] * repeats, 0))])
        for q, found in enumerate(best):
            a, b = starts[q], starts[q + 1]
            if bounds[b] - bounds[a] < found.least():
                continue
            lists = []
            for i in np.flatnonzero(here[a:b]) + a:
                t, r = at[i], int(repeats[i])
                span = slice(ends[t] - df[t], ends[t])
                lists.append((docs[span], adds[span] * r, int(most[t]) * r))
            _ranked(lists, known, ids, found)

    return rows


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """The result for a bounded number of items."""
    spark = docs.sparkSession
    asked = [Counter(terms(item.text)) for item in items]
    vocabulary = {term: number for number, term in enumerate(sorted({t for counts in asked for t in counts}))}
    blocks = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_posted(vocabulary), _BLOCK), "postings")
    sizes = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(sizes[0]), max(int(sizes[1]), 1)
    pairs = blocks.select(F.inline(F.arrays_zip("term", "df"))).groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in pairs.toLocalIterator():  # at most one row per term of the items
        weights[row.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row.df + 1)))
    queries = [sorted((vocabulary[t], r) for t, r in counts.items()) for counts in asked]
    best = blocks.drop("n_docs", "n_terms").mapInArrow(_searched(queries, weights, n_docs, n_terms, k), "q long, score long, doc_id long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame([(number, item.item_id) for number, item in enumerate(items)], "q long, item_id " + items[0].kind)
    return ranked.join(F.broadcast(named), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def searched(docs: DataFrame, items: DataFrame, k: int = K, query_chars: int = QUERY_CHARS) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score."""
    small_batches(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    size = F.length(F.coalesce("text", F.lit(""))) + 1
    items = items.select("item_id", "text", size.alias("size"), F.lit(kind).alias("kind"))
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // query_chars))  # half full on average, so that parts stay below the bound
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    result = None
    for part in range(parts):
        block = items.where(F.col("part") == part).collect()
        if block:
            found = _search_block(docs, block, k)
            result = found if result is None else result.unionByName(found)
    if result is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return result


#: DuckDB: all scores, then the ranks.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents
), q AS (
  SELECT row_number() OVER () AS q, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM benchmark
), s AS (SELECT count(*) FILTER (len(t) > 0)::bigint AS n, sum(len(t))::bigint AS l FROM d
), norm AS (SELECT d, doc_id, 100 - 25 + ((25 * len(t) * n) // l) AS m FROM d, s WHERE len(t) > 0
), tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM d) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), asked AS (SELECT q, item_id, term, count(*) AS r FROM (SELECT q, item_id, unnest(t) AS term FROM q) GROUP BY ALL
), w AS (SELECT q, item_id, term, r, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)::double))::bigint AS w FROM asked JOIN df USING (term), s
), scores AS (
  SELECT q, item_id, d, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint AS score
  FROM w JOIN tf USING (term) JOIN norm USING (d) GROUP BY ALL
)
SELECT item_id, rank::int AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""
