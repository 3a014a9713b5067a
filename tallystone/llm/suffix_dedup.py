"""Suffix-array dedup by a distributed merge sort that knows common prefixes.

A 400-byte string is repeated if two suffixes that begin with it stand next to each other in
sorted order. Not every suffix is sorted: each 400-byte window is represented by one place in it,
its anchor, the one whose 16-byte hash is least among places with BASE bytes ahead. Equal windows have
their anchors at equal places, so only suffixes at anchors are sorted, and of these only the ones
whose first BASE bytes stand more than once in the corpus (counted by hash).

Each task sorts its suffixes into runs and codes them from the front: how much a suffix shares with
the one before, and the rest. Runs are cut at splitters that never part suffixes with equal first
BASE bytes, exchanged, and merged by loser trees: contestants carry the length they share with the
last winner, the longer share wins unseen, and equal shares are compared from there on only. The
merge gives the order and the common prefix of all neighbours. With the bytes to the left of the
anchors sorted likewise, a window at offset o is a pair: the class of neighbours that share its bytes
from the anchor on, and the class that shares its o bytes before. Equal pairs are equal windows,
byte for byte.

Anchors with more than HOT occurrences would meet in one task: of their windows, those that a task
finds twice are settled there, and the others are counted one by one by hash and joined back. Cases: null and short texts lose nothing; rows
that repeat id and text are documents of their own and lose what they share; spans that touch or
overlap count as one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import grown, merged, shrunk, small_batches
from tallystone.llm.window_dedup import LONE, LOT, counted, longer, settled
from tallystone.session import stored

WINDOW = 400
BASE = 64
HOT = 1 << 16  # suffixes with equal BASE bytes that one task merges; about 1 kB each
TILE = 1 << 19  # windows whose anchors are chosen at a time
RUN_BYTES = 24 << 20  # suffix bytes sorted into one run
PART = 20_000  # suffixes meant for one merge
SAMPLED = 256  # one anchor in so many is asked for splitters
SAMPLE = 1 << 16  # suffixes that the splitters are chosen from, at most

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all spans of ``width`` values: from block ends backwards and block starts forwards."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def anchors(text: bytes, window: int = WINDOW, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the anchors of a text and the windows that each stands for."""
    n, width = len(text) - window + 1, window - base + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    words = np.ndarray((len(text) - 7,), "<u8", buffer=text, strides=(1,))
    found, first = [], []
    for at in range(0, n, TILE):
        many = min(TILE, n - at) + width - 1
        with np.errstate(over="ignore"):
            x = words[at : at + many] * _A + (words[at + 8 : at + 8 + many] ^ _C) * _B
            x ^= x >> np.uint64(32)
            x *= _C
        least = _least((x & _HIGH) | np.arange(many, dtype=np.uint64), width)
        starts = np.flatnonzero(np.diff(least, prepend=least[0] ^ np.uint64(1)))
        found.append((least[starts] & ~_HIGH).astype(np.int64) + at)
        first.append(starts + at)
    a, i = np.concatenate(found), np.concatenate(first)
    new = np.diff(a, prepend=-1) != 0  # an anchor that goes on in the next tile
    a, i = a[new], i[new]
    return a, i, np.append(i[1:], n) - 1


def _gram(text: bytes, a: int, base: int) -> int:
    value = xxhash.xxh64_intdigest(text[a : a + base], 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def _places(texts: Iterator[pd.Series], window: int, base: int) -> Iterator[pd.Series]:
    for batch in texts:
        out = []
        for text in batch:
            whole = (text or "").encode()
            grams = [(_gram(whole, a, base), whole[a : a + base]) for a in anchors(whole, window, base)[0].tolist()]
            out.append([(h, g if h % SAMPLED == 0 else None) for h, g in grams])
        yield pd.Series(out)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share their first ``known`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


Suffix = tuple[bytes, bytes, int, int, int, int]  # bytes ahead, bytes behind reversed, doc, t, anchor, least offset


def coded(run: list[Suffix], splitters: list[bytes], base: int) -> Iterator[tuple]:
    """Pieces (part, blob) of a sorted run; a blob is front-coded from its own first suffix."""
    pack = zstandard.ZstdCompressor(level=1).compress
    run.sort(key=lambda s: s[0])
    at = 0
    while at < len(run):
        part = bisect_right(splitters, run[at][0][:base])
        end = at + 1
        if part < len(splitters):
            low, high = at, len(run)
            while low + 1 < high:
                middle = (low + high) // 2
                low, high = (middle, high) if run[middle][0][:base] < splitters[part] else (low, middle)
            end = high
        else:
            end = len(run)
        piece = run[at:end]
        lcp = [0, *(shared(p[0], q[0], 0) for p, q in zip(piece, piece[1:]))]
        numbers = np.array([(h, len(s[0]) - h, len(s[1]), s[4], s[5]) for h, s in zip(lcp, piece)], np.int32).tobytes()
        ids = np.array([s[2:4] for s in piece], np.int64).tobytes()
        rest = b"".join(s[0][h:] for h, s in zip(lcp, piece))
        yield part, pack(numbers), pack(ids), pack(rest), pack(b"".join(s[1] for s in piece))
        at = end


def decoded(numbers: bytes, ids: bytes, rest: bytes, behind: bytes) -> Iterator[tuple[int, Suffix]]:
    """(shared with the one before, suffix) of a piece, in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    numbers, ids, rest, behind = unpack(numbers), unpack(ids), unpack(rest), unpack(behind)
    ahead, p, q = b"", 0, 0
    for (h, n, m, anchor, offset), (doc, t) in zip(np.frombuffer(numbers, np.int32).reshape(-1, 5).tolist(), np.frombuffer(ids, np.int64).reshape(-1, 2).tolist()):
        ahead = ahead[:h] + rest[p : p + n]
        yield h, (ahead, behind[q : q + m], doc, t, anchor, offset)
        p, q = p + n, q + m


def merge(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """Sorted runs as one, with the length that each suffix shares with the one before.

    ``share[r]`` is what the head of run r shares with the last suffix put out or, for a loser
    in the tree, with the one that beat it, which is what it shares with the next winner there."""
    k = len(runs)
    heads: list[Suffix | None] = [None] * k
    share = [0] * k
    for r, run in enumerate(runs):
        _, heads[r] = next(run, (0, None))
    loser = [-1] * k

    def beats(r: int, s: int) -> bool:
        """Whether run r goes before run s; the loser's share becomes that with the winner."""
        if heads[s] is None:
            return True
        if heads[r] is None:
            return False
        if share[r] != share[s]:
            return share[r] > share[s]
        a, b = heads[r][0], heads[s][0]
        m = shared(a, b, share[r])
        first = a[m : m + 1] <= b[m : m + 1]
        share[s if first else r] = m
        return first

    def play(r: int, node: int) -> int:
        while node:
            s = loser[node]
            if s < 0:  # the tree is being set up: wait for the other side
                loser[node] = r
                return -1
            if not beats(r, s):
                loser[node], r = r, s
            node //= 2
        return r

    winner = -1
    for r in range(k):
        winner = max(winner, play(r, (r + k) // 2)) if k > 1 else r
    while heads[winner] is not None:
        yield share[winner], heads[winner]
        share[winner], heads[winner] = next(runs[winner], (0, None))
        winner = play(winner, (winner + k) // 2)


def repeated_windows(suffixes: list[Suffix], lcp: np.ndarray, window: int, base: int) -> pd.DataFrame:
    """Spans under repeated windows among sorted suffixes that hold whole groups of equal base bytes."""
    n = len(suffixes)
    lcp = np.append(lcp, 0)
    lcp[0] = 0
    alike = np.maximum(lcp[:-1], lcp[1:])  # bytes ahead that some other suffix shares
    low = np.array([s[5] for s in suffixes])
    high = np.array([len(s[1]) for s in suffixes])
    order = np.array(sorted(range(n), key=lambda k: suffixes[k][1]))
    behind = [suffixes[k][1] for k in order]
    left = np.array([0, *(shared(a, b, 0) for a, b in zip(behind, behind[1:]))])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    found = np.zeros((n, int(high.max()) + 2), bool)  # by suffix and offset, with an empty column at the end
    for o in range(int(low.min()), int(high.max()) + 1):
        here = np.flatnonzero((low <= o) & (o <= high) & (alike >= window - o))
        if len(here) < 2:
            continue
        ahead_class = np.cumsum(lcp[:-1] < window - o)[here]
        behind_class = np.cumsum(left < o)[rank[here]]
        pair = ahead_class * np.int64(n + 1) + behind_class
        by = np.argsort(pair, kind="stable")
        same = np.diff(pair[by]) == 0
        found[here[by[np.append(same, False) | np.append(False, same)]], o] = True
    # neighbouring offsets are one span: from the farthest offset's place to the end of the nearest one's window
    edges = np.diff(found.view(np.int8), axis=1, prepend=np.int8(0))
    row, nearest = np.nonzero(edges == 1)
    farthest = np.nonzero(edges == -1)[1] - 1
    anchor = np.array([s[4] for s in suffixes])[row]
    whose = [suffixes[k] for k in row]
    return pd.DataFrame({"doc_id": [s[2] for s in whose], "t": [s[3] for s in whose], "start": anchor - farthest, "stop": anchor - nearest + window}).astype("int64")


PIECES = "part int, numbers binary, ids binary, rest binary, behind binary"
SPANS = "doc_id long, t long, start long, stop long"


def _candidates(batch: pd.DataFrame, window: int, base: int) -> Iterator[tuple]:
    """(doc, t, text, anchor, first, last) of the repeated anchors of a batch of documents."""
    for doc, t, packed, wanted in zip(batch["doc_id"], batch["t"], batch["packed"], batch["candidates"]):
        text = grown(packed).encode()
        a, first, last = (x.tolist() for x in anchors(text, window, base))
        for j in sorted(set(wanted)):
            yield doc, t, text, a[j], first[j], last[j]


def _runs(batches: Iterator[pd.DataFrame], splitters: list[bytes], window: int, base: int) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PIECES.split(", ")]
    run: list[Suffix] = []
    size = 0
    for batch in batches:
        for doc, t, text, a, first, last in _candidates(batch, window, base):
            run.append((text[a : last + window], text[first:a][::-1], doc, t, a, a - last))
            size += last + window - first
            if size >= RUN_BYTES:
                yield pd.DataFrame(coded(run, splitters, base), columns=names)
                run, size = [], 0
    if run:
        yield pd.DataFrame(coded(run, splitters, base), columns=names)


def _merged(batches: Iterator[pd.DataFrame], window: int, base: int) -> Iterator[pd.DataFrame]:
    """Merge the pieces of each part (rows sorted by part) and find the repeated windows."""

    def of_part(pieces: list[tuple]) -> Iterator[pd.DataFrame]:
        group: list[Suffix] = []
        lcp: list[int] = []
        for h, suffix in merge([decoded(*p) for p in pieces]):
            if h < base and len(group) >= PART:
                yield repeated_windows(group, np.array(lcp), window, base)
                group, lcp = [], []
            group.append(suffix)
            lcp.append(h)
        if group:
            yield repeated_windows(group, np.array(lcp), window, base)

    part, pieces = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.part != part and pieces:
                yield from of_part(pieces)
                pieces = []
            part = row.part
            pieces.append(tuple(row[1:]))
    if pieces:
        yield from of_part(pieces)


def _hot_windows(batches: Iterator[pd.DataFrame], window: int, base: int) -> Iterator[pd.DataFrame]:
    """All windows around hot anchors; those that a lot holds twice are settled at once."""
    found: list[tuple] = []
    size = 0
    for batch in batches:
        for doc, t, text, _, first, last in _candidates(batch, window, base):
            letters = np.frombuffer(text, np.uint8)[first : last + window].astype(np.uint64) * _A + _B
            hashes = longer(letters ^ (letters >> np.uint64(29)), 1, window).view(np.int64)
            found.append((np.full(len(hashes), doc), np.full(len(hashes), t), np.arange(first, last + 1), hashes))
            size += len(hashes)
            if size >= LOT:
                yield settled(*map(np.concatenate, zip(*found)), window)
                found, size = [], 0
    if found:
        yield settled(*map(np.concatenate, zip(*found)), window)


def repeated_spans(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """(doc_id, t, start, stop) for ``docs`` with doc_id and t (which together tell texts apart) and text."""
    grams = F.pandas_udf(lambda texts: _places(texts, window, base), "array<struct<h:bigint,gram:binary>>", F.PandasUDFType.SCALAR_ITER)
    places = stored(docs.select("doc_id", "t", F.posexplode(grams("text")).alias("j", "g")).select("doc_id", "t", "j", "g.*"), "anchors")
    repeated = stored(places.groupBy("h").agg(F.count("j").alias("n")).where("n > 1"), "repeated")
    cold, hot = repeated.where(F.col("n") <= HOT), repeated.where(F.col("n") > HOT)
    sizes = repeated.agg(F.sum(F.when(F.col("n") <= HOT, F.col("n"))).alias("cold"), F.count_if(F.col("n") > HOT).alias("hot")).first()
    parts = (sizes["cold"] or 0) // PART + 1
    sample = places.where("gram is not null").join(cold, "h").select("gram").orderBy(F.xxhash64("doc_id", "t", "j")).limit(SAMPLE).collect() if parts > 1 else []
    known = sorted(bytes(r["gram"]) for r in sample)
    splitters = sorted({known[k * len(known) // parts] for k in range(1, parts)}) if known else []
    packed = docs.select("doc_id", "t", shrunk(F.col("text")).alias("packed"))

    def asked(which: DataFrame) -> DataFrame:
        wanted = places.select("doc_id", "t", "j", "h").join(which, "h").groupBy("doc_id", "t").agg(F.collect_list("j").alias("candidates"))
        return packed.join(wanted, ["doc_id", "t"])

    runs = asked(cold).mapInPandas(lambda b: _runs(b, splitters, window, base), PIECES)
    spans = runs.repartition(len(splitters) + 1, "part").sortWithinPartitions("part").mapInPandas(lambda b: _merged(b, window, base), SPANS)
    if sizes["hot"]:
        lone = stored(asked(hot).mapInPandas(lambda b: _hot_windows(b, window, base), LONE), "hot-windows")
        spans = spans.unionByName(counted(lone))
    return spans


def _kept(text: str | None, spans: list | None) -> tuple[int, int, int, str]:
    whole = (text or "").encode()
    removed = merged((s["start"], s["stop"]) for s in spans) if spans is not None else []
    digest, at = hashlib.sha256(), 0
    for start, stop in removed:
        digest.update(whole[at:start])
        at = stop
    digest.update(whole[at:])
    return len(whole), sum(b - a for a, b in removed), len(removed), digest.hexdigest()


def judged(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``."""
    small_batches(docs.sparkSession)
    t = F.xxhash64("text", F.col("doc_id").isNull())
    keyed = docs.select(F.col("doc_id").alias("id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), t.alias("t"), "text")
    spans = repeated_spans(keyed.drop("id"), window, base).groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = keyed.select("id", "doc_id", "t", shrunk(F.col("text")).alias("packed")).join(spans, ["doc_id", "t"], "left")

    @F.pandas_udf("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    def result(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_kept(grown(x), s) for x, s in zip(texts, spans)], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select(F.col("id").alias("doc_id"), result("packed", "spans").alias("r")).select("doc_id", "r.*")
