"""Substring dedup by level-wise doubling of word windows.

A window of 35 words is repeated only if the windows of 18 words in it are, and those only if their
windows of 9 words are. So the corpus is first searched for the shortest windows, and only where one
is repeated are windows of twice the length looked at, up to the wanted length.

On the first level not every place is counted: each wanted window is represented by the one window
of 9 words in it whose hash is least (its anchor). Equal windows have their anchors at equal
places, so a wanted window with a unique anchor is unique; about one place in fourteen is an anchor.
Anchors are counted over the corpus. The wanted windows around repeated anchors are then sent,
as hashes, to the task that has all occurrences of their anchor; there the windows of twice the
length beside the anchor are compared, and the wanted windows of those that survive. Anchors with
more than HOT occurrences go another way: each task settles the windows it finds twice itself, and
the others are counted one by one and joined back, so nothing gathers in one task.

Windows are compared by 64-bit hashes within occurrences of one 64-bit anchor hash. Cases: null,
blank and short texts have no windows and lose nothing; every row is a document, so rows that
repeat id and text lose each other's windows; words are kept as bytes, unchanged. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import grown, merged, shrunk, small_batches
from tallystone.session import stored

WINDOW = 35
HOT = 1 << 16  # occurrences of an anchor that one task compares; about 300 bytes each
TILE = 1 << 17  # windows whose anchors are chosen at a time
GATHERED = 20_000  # rows of whole anchor groups that are compared at a time

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)


def levels(window: int = WINDOW, shortest: int = 8) -> list[int]:
    """Lengths from the shortest level to the wanted one, each at most twice the one before."""
    found = [window]
    while (half := -(-found[0] // 2)) > shortest:
        found.insert(0, half)
    return found


class WordHashes:
    """Hashes of words, remembered for frequent ones."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.known: dict[bytes, int] = {}
        self.most = most

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w, 42)
            out[i] = h
        return out


def longer(hashes: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Hashes of all windows of ``wanted`` units from those of ``length``, at most half as long or
    longer than half: two of them side by side or overlapping make one."""
    while length < wanted:
        step = min(length, wanted - length)
        if len(hashes) <= step:
            return hashes[:0]
        with np.errstate(over="ignore"):
            x = hashes[:-step] * _A + (hashes[step:] ^ (hashes[step:] >> np.uint64(29))) * _B
            x ^= x >> np.uint64(32)
            hashes = x * _C
        length += step
    return hashes


def anchors(hashes: np.ndarray, base: int, window: int) -> np.ndarray:
    """For each window of ``window`` units, the place of its anchor; ``hashes`` are of length ``base``."""
    width, n = window - base + 1, len(hashes) - (window - base)
    if n <= 0:
        return np.empty(0, np.int64)
    parts = []
    for at in range(0, n, TILE):
        many = min(TILE, n - at)
        view = np.lib.stride_tricks.sliding_window_view(hashes[at : at + many + width - 1], width)
        parts.append(view.argmin(axis=1) + np.arange(at, at + many))
    return np.concatenate(parts)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _anchor_column(window: int):
    base = levels(window)[0]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of(texts: pd.Series) -> pd.Series:
        hashes, out = WordHashes(), []
        for text in texts:
            short = longer(hashes.of(words_of(text)), 1, base)
            out.append(short[np.unique(anchors(short, base, window))].view(np.int64))
        return pd.Series(out)

    return of


ROWS = "c long, n long, doc_id long, t long, at int, anchor int, sides binary, hashes binary"


def _windows(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """The wanted windows around repeated anchors, by anchor: first place, hashes, and the hashes of
    the two windows of the second level that the anchor begins and ends."""
    base, second = levels(window)[0], levels(window)[1]
    known = WordHashes()
    for batch in batches:
        out = []
        for doc_id, t, packed, candidates in zip(batch["doc_id"], batch["t"], batch["packed"], batch["candidates"]):
            short = longer(known.of(words_of(grown(packed))), 1, base)
            middle = longer(short, base, second)
            whole = longer(middle, second, window)
            of = anchors(short, base, window)
            places, first, many = np.unique(of, return_index=True, return_counts=True)
            for j, n in {c["j"]: c["n"] for c in candidates}.items():
                a, i = int(places[j]), int(first[j])
                left, right = a - (second - base), a
                sides = np.array([middle[left] if left >= 0 else 0, middle[right] if right < len(middle) else 0], np.uint64)
                out.append((short[a].view(np.int64), n, doc_id, t, i, a, sides.tobytes(), whole[i : i + many[j]].tobytes()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"doc_id": "Int64"})


def _twice(values: np.ndarray) -> np.ndarray:
    """Which of the values occur more than once."""
    if not len(values):
        return np.zeros(0, bool)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _compared(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Spans of words under repeated windows, for rows that hold whole anchor groups."""
    base, second = levels(window)[0], levels(window)[1]
    hashes = [np.frombuffer(h, "<u8") for h in rows["hashes"]]
    size = np.array([len(h) for h in hashes])
    row = np.repeat(np.arange(len(rows)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(rows["at"].to_numpy(), size)
    offset = np.repeat(rows["anchor"].to_numpy(), size) - place
    sides = np.frombuffer(b"".join(rows["sides"]), "<u8").reshape(-1, 2)
    left, right = _twice(sides[:, 0]), _twice(sides[:, 1])
    # a window that holds a unique window of the second level is unique
    alive = (left[row] | (offset < second - base)) & (right[row] | (offset > window - second))
    row, place, values = row[alive], place[alive], np.concatenate(hashes)[alive]
    again = _twice(values)
    row, place = row[again], place[again]
    starts = np.flatnonzero(np.diff(row, prepend=-1) | (np.diff(place, prepend=-2) != 1))
    ends = np.append(starts[1:], len(row)) - 1 if len(row) else starts
    found = rows.iloc[row[starts]][["doc_id", "t"]].reset_index(drop=True)
    found["start"], found["stop"] = place[starts].astype(np.int32), (place[ends] + window).astype(np.int32)
    return found


def _groups(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Compare rows sorted by anchor, in lots of whole groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        if sum(map(len, held)) >= GATHERED:
            rows = pd.concat(held)
            open_ = rows["c"] == rows["c"].iloc[-1]
            if not open_.all():
                yield _compared(rows[~open_], window)
                held = [rows[open_]]
            else:
                held = [rows]
        held.append(batch)
    if held:
        yield _compared(pd.concat(held), window)


LONE = "doc_id long, t long, start long, stop long, h long, kind int"
SPAN, WINDOW_ALONE, KNOWN = 0, 1, 2
LOT = 200_000  # windows of hot anchors that are looked through at a time


def settled(doc_id: np.ndarray, t: np.ndarray, start: np.ndarray, h: np.ndarray, window: int) -> pd.DataFrame:
    """Rows of LONE for some windows. Those found twice among them are settled here: their places
    come out as spans (SPAN), and each of their hashes once, for windows elsewhere (KNOWN). The
    rest (WINDOW_ALONE) are to be counted over the corpus. ``doc_id`` may be a masked array."""
    again = _twice(h)
    d, at = pd.array(doc_id, "Int64")[again], start[again]
    whose = d.to_numpy(np.int64, na_value=np.iinfo(np.int64).min)
    apart = lambda x: np.append(True, x[1:] != x[:-1])[: len(x)]
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | apart(t[again]) | apart(whose))
    last = np.append(new[1:], len(at)) - 1 if len(at) else new
    spans = pd.DataFrame({"doc_id": d[new], "t": t[again][new], "start": at[new], "stop": at[last] + window, "kind": SPAN})
    known = pd.DataFrame({"h": np.unique(h[again]), "kind": KNOWN})
    alone = pd.DataFrame({"doc_id": doc_id[~again], "t": t[~again], "start": start[~again], "stop": start[~again] + window, "h": h[~again], "kind": WINDOW_ALONE})
    names = [c.split()[0] for c in LONE.split(", ")]
    # nullable before they are put together: a missing column would make floats of the hashes
    return pd.concat([x.reindex(columns=names).astype("Int64") for x in (spans, known, alone)])


def _hot(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch["hashes"].str.len().sum() // 8
        if size >= LOT:
            yield _settled_rows(pd.concat(held), window)
            held, size = [], 0
    if size:
        yield _settled_rows(pd.concat(held), window)


def _settled_rows(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    hashes = [np.frombuffer(h, "<i8") for h in rows["hashes"]]
    size = np.array([len(h) for h in hashes])
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(rows["at"].to_numpy(np.int64), size)
    doc_id = rows["doc_id"].astype("Int64").array[np.repeat(np.arange(len(rows)), size)]
    return settled(doc_id, np.repeat(rows["t"].to_numpy(np.int64), size), start, np.concatenate(hashes), window)


def counted(lone: DataFrame) -> DataFrame:
    """(doc_id, t, start, stop) of the windows in rows of LONE that stand in more than one place."""
    asked = lone.where(F.col("kind") != SPAN).groupBy("h").agg(F.sum("kind").alias("n")).where("n > 1").select("h")
    alone = lone.where(F.col("kind") == WINDOW_ALONE).join(asked, "h")
    names = ["doc_id", "t", "start", "stop"]
    return lone.where(F.col("kind") == SPAN).select(*names).unionByName(alone.select(*names))


SPANS = "doc_id long, t long, start int, stop int"


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, start, stop): spans of words under windows that stand elsewhere too. ``docs`` has
    doc_id, t (hash of the text) and text."""
    # counted and joined: read from a table, the texts are hashed once
    places = stored(docs.select("doc_id", "t", F.posexplode(_anchor_column(window)(F.col("text"))).alias("j", "h")), "anchors")
    repeated = places.groupBy("h").agg(F.count("j").alias("n")).where("n > 1")
    candidates = places.join(repeated, "h").groupBy("doc_id", "t").agg(F.collect_set(F.struct("j", "n")).alias("candidates")).alias("c")
    packed = docs.select("doc_id", "t", shrunk(F.col("text")).alias("packed")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.t") == F.col("c.t"))
    asked = packed.join(candidates, same).select("d.*", "candidates")
    rows = stored(asked.mapInPandas(lambda b: _windows(b, window), ROWS), "windows")
    cold = rows.where(F.col("n") <= HOT).repartition("c").sortWithinPartitions("c").mapInPandas(lambda b: _groups(b, window), SPANS)

    hot = stored(rows.where(F.col("n") > HOT).mapInPandas(lambda b: _hot(b, window), LONE), "hot-windows")
    return cold.unionByName(counted(hot).withColumns({"start": F.col("start").cast("int"), "stop": F.col("stop").cast("int")}))


def _kept(text: str | None, spans: list | None) -> tuple[int, int, str]:
    words = words_of(text)
    removed = merged((s["start"], s["stop"]) for s in spans) if spans is not None else []
    kept, at = [], 0
    for start, stop in removed:
        kept += words[at:start]
        at = stop
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def judged(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    spans = repeated_spans(keyed, window).groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).alias("s")
    packed = keyed.select("doc_id", "t", shrunk(F.col("text")).alias("packed")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.t") == F.col("s.t"))

    @F.pandas_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def result(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_kept(grown(t), s) for t, s in zip(texts, spans)], columns=["n_words", "n_removed", "kept_sha256"])

    return packed.join(spans, same, "left").select("d.doc_id", result("packed", "spans").alias("r")).select("doc_id", "r.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i : md5(array_to_string(w[i : i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM p) WHERE n > 1),
cut AS (SELECT r, list(i ORDER BY i) AS cuts, count(*) AS n FROM hit GROUP BY r),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN hit USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""
