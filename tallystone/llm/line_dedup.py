"""Line dedup over content-defined chunks of lines.

Rolling hashes over the hashes of lines set the borders: a window of WINDOW lines rolls over the text, and
a line starts a chunk where the rolling hash of the window that starts with it is smaller than those of the windows
before and after, as far as there are (the first line is a border anyway; its window is not compared).
A border depends on WINDOW + 2 lines, so a passage that several documents share is
cut alike wherever it stands, and chunks have two lines or more. A run of equal lines has no
minimum: it is cut where it starts, after every second line and where it ends. Chunks of equal
bytes that stand in more than one place of the corpus are repeated: the first (smallest doc_id,
then first in the text) stays, later ones go. Lines of a repeated passage outside its whole chunks
stay; the README says how many.

One aggregate over (hash, compressed bytes) compares the bytes; copies combine map-side, so a chunk that a
third of the documents share is one row per task. Every place is then joined to the chunk's first
document on the 64-bit hash; where different bytes share a hash, the bytes go along and decide.

Cases: a null text stays null and has no lines; a text of one line, or a single line between
borders (only at a text's ends), is never removed, nor are chunks without a word. Line ends are
``\\n``; a chunk carries its own. Rows that repeat a doc_id with different texts are documents of their own, in order of the texts' hashes; rows
that repeat both are one document, kept as often as it stands there. Null ids come last. Other
columns stay, also when they are named like helpers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import column, free_name, grown, shrunk, small_batches

Chunk = tuple[int, int, int]  # first byte, byte after the last, lines

WINDOW = 2  # lines under a rolling hash
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that no line of a window is lost modulo 2**64


def rolling(hashes: np.ndarray) -> np.ndarray:
    """Rolling hash of each window of WINDOW lines: a polynomial of the lines' hashes, its high bits mixed into the low ones."""
    n = max(len(hashes) - WINDOW + 1, 0)
    out = np.zeros(n, np.uint64)
    for place in range(WINDOW):
        out = out * BASE + hashes[place : place + n]
    return out ^ (out >> np.uint64(29))


def _borders(hashes: np.ndarray) -> np.ndarray:
    """Which lines start a chunk, the first line aside."""
    n = len(hashes)
    same = hashes[1:] == hashes[:-1]
    end, start, low = np.zeros((3, n), bool)
    end[2:] = same[:-1] & ~same[1:]  # the line after a run of equal lines
    start[1:-1] = same[1:] & ~same[:-1]  # the first line of a run
    start[1:] &= ~end[:-1]  # a single line between two runs goes with the second
    rolled = rolling(hashes)[1:]  # of the windows that start with the second line, the third, ...
    less = rolled[1:] < rolled[:-1]
    low[1 : 1 + len(rolled)] = True
    low[2 : 2 + len(less)] &= less
    low[1 : 1 + len(less)] &= rolled[:-1] < rolled[1:]
    low[1:] &= ~same & ~end[:-1]
    low[:-1] &= ~start[1:]
    at = np.arange(n)
    deep = at - np.maximum.accumulate(np.where(np.append(False, same), 0, at))  # place within a run
    pairs = (deep > 0) & (deep % 2 == 0) & np.append(same, False)
    return end | start | low | pairs


def chunks(text: bytes) -> list[Chunk]:
    """Chunks of a text. A line starts a chunk where the rolling hash of its window is a strict minimum among its two
    neighbours, where a run of equal lines starts or has ended, and at every second line of a run."""
    if not text:
        return []
    parts = text.split(b"\n")
    ends = np.cumsum([len(p) + 1 for p in parts])
    ends[-1] -= 1
    if ends[-1] == (ends[-2] if len(ends) > 1 else 0):  # the text ends with \n
        parts.pop()
        ends = ends[:-1]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    borders = [0, *np.flatnonzero(_borders(hashes)).tolist(), len(parts)]
    at = [0, *ends.tolist()]
    return [(at[a], at[b], b - a) for a, b in zip(borders, borders[1:])]


def _hash(chunk: bytes) -> int:
    value = xxhash.xxh64_intdigest(chunk)
    return value - (1 << 64) if value >= 1 << 63 else value


def _candidates(text: str | None) -> list[tuple[int, bytes]]:
    """(hash, bytes) of chunks that may be removed: two lines or more, with a word. A chunk's last
    line end does not count, so a passage at the end of a text equals one inside."""
    whole = (text or "").encode()
    found = ((n, whole[a:b].removesuffix(b"\n")) for a, b, n in chunks(whole))
    return [(_hash(c), c) for n, c in found if n > 1 and c.strip()]


def _occurrences(batches: Iterator[pd.DataFrame], with_bytes: bool) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=1).compress  # one version of it: equal bytes stay equal
    for batch in batches:
        for at in range(0, len(batch), 512):
            rows = [
                (id_, t, h, pack(c)) if with_bytes else (id_, t, h)
                for id_, t, text in batch.iloc[at : at + 512].itertuples(index=False)
                for h, c in _candidates(text)
            ]
            yield pd.DataFrame(rows, columns=["id", "t", "h", "bytes"] if with_bytes else ["id", "t", "h"])


def _without(text: str | None, known: list | None) -> tuple[str | None, int, int, int, int]:
    """Text without later copies; lines, chunks removed, lines removed, chunks that are repeated."""
    if text is None:
        return None, 0, 0, 0, 0
    whole = text.encode()
    repeated: dict[int, list] = {}
    for k in known if known is not None else ():
        clash = k["bytes"] and zstandard.ZstdDecompressor().decompress(k["bytes"])
        repeated.setdefault(k["h"], []).append((k["mine"], clash))
    kept, seen = [], set()
    n_lines = n_chunks = n_removed = n_repeated = 0
    for a, b, n in chunks(whole):
        chunk = whole[a:b].removesuffix(b"\n")
        n_lines += n
        mine = None  # whether the chunk's first place is in this document; None: not repeated
        if n > 1 and repeated and chunk.strip():
            mine = next((m for m, c in repeated.get(_hash(chunk), ()) if c is None or c == chunk), None)
        n_repeated += mine is not None
        if mine is False or (mine and chunk in seen):
            n_chunks += 1
            n_removed += n
            continue
        if mine:
            seen.add(chunk)
        kept.append(whole[a:b])
    out = b"".join(kept)
    if n_removed and kept and not whole.endswith(b"\n"):
        out = out.removesuffix(b"\n")
    return out.decode(), n_lines, n_chunks, n_removed, n_repeated


RESULT = "text string, n_lines bigint, n_chunks_removed bigint, n_lines_removed bigint, n_chunks_repeated bigint"
LAST = (1 << 63) - 1


def _place() -> Column:
    """Order of documents: by id, then by the hash of their texts (below 10**18), as one number that an
    aggregate can hold in place."""
    low = F.pmod(F.col("t"), F.lit(10**18)).cast("decimal(18,0)")
    return (F.col("id").cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def repeated_chunks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks in more than one place: (h, first, n, shared) by hash, where ``shared`` tells that
    different bytes have the hash, and (h, n, first, bytes) by bytes. ``docs``: id (not null), t, text."""
    places = docs.mapInPandas(lambda b: _occurrences(b, True), "id bigint, t bigint, h bigint, bytes binary")
    equal = places.groupBy("h", "bytes").agg(F.count("id").alias("n"), F.min(_place()).alias("first"))
    by_hash = equal.select("h", "n", "first", F.when(F.col("n") > 1, F.col("bytes")).alias("bytes"))
    one = by_hash.groupBy("h").agg(F.count("n").alias("texts"), F.sum("n").alias("n"), F.min("first").alias("first"))
    return one.where("n > 1").select("h", "first", "n", (F.col("texts") > 1).alias("shared")), by_hash.where("n > 1")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column as RESULT, the text without later copies and counts, in place
    of the text.

    Returns (frame, name of the struct column)."""
    small_batches(docs.sparkSession)
    names = [free_name(docs, n) for n in ("_id", "_t", "_known", "_result")]
    id_, t = F.coalesce(column(docs, "doc_id"), F.lit(LAST)), F.xxhash64(column(docs, "text"))
    base = docs.select(id_.alias("id"), t.alias("t"), column(docs, "text").alias("text"))
    one, by_text = repeated_chunks(base)
    plain = one.where(~F.col("shared")).select("h", "first", F.lit(None).cast("binary").alias("bytes"))
    clash = by_text.join(one.where("shared").select("h"), "h").select("h", "first", "bytes")
    places = base.mapInPandas(lambda b: _occurrences(b, False), "id bigint, t bigint, h bigint").distinct()
    known = places.join(plain.unionByName(clash), "h").groupBy("id", "t").agg(F.collect_list(F.struct("h", (F.col("first") == _place()).alias("mine"), "bytes")).alias("known"))
    # whole texts cross the shuffle compressed
    whole = free_name(docs, "_text")
    keyed = docs.withColumns({names[0]: id_, names[1]: t, whole: shrunk(column(docs, "text"))}).drop("text")
    joined = keyed.join(known.toDF(*names[:3]), names[:2], "left")

    @F.pandas_udf(RESULT)
    def result(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_without(grown(text), k) for text, k in zip(texts, known)], columns=[c.split()[0] for c in RESULT.split(", ")])

    return joined.withColumn(names[3], result(F.col(whole), F.col(names[2]))).drop(*names[:3], whole), names[3]


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, what stays of the text, and the counts of lines and chunks."""
    out, result = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", f"{result}.*")


def with_texts_replaced(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining texts and, where there is such a column, their n_chars."""
    out, result = deduplicated(docs)
    new = {"text": F.col(result)["text"], "n_chars": F.length(F.col(result)["text"]).cast("bigint")}
    return out.select(*(new[c].alias(c) if c in new else column(out, c) for c in docs.columns))
