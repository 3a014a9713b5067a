"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is laid out as a ring of segments. If two fingerprints differ in at most
``radius`` bits, then from some segment on, the first l segments together differ in at most
``l * radius / segments`` bits, for every l. So only pairs are looked at whose chain starts with
an equal segment and stays within these budgets; then comes the full Hamming check.

``linked``: exact. Every link of at most ``radius`` bits between 64-bit fingerprints is found. The
first two budgets of the chain become an equality join: each fingerprint is asked for under its
first two segments and under each value that one allowed bit makes of them.

``without_near_copies``: for documents that are alike by Jaccard similarity (five-word shingles,
0.8), and with ``ring`` for those that ``linked`` links as well. By similarity, copies differ in about
a seventh of the bits, which no short segment of a plain fingerprint survives. Their ring is
therefore one of shingle classes: shingles are dealt into as many classes as differences are to be expected, so that some classes stay untouched (budget 0).
Pairs with an equal class whose 512-bit fingerprints are within a radius with room above the mean are
candidates; the documents that candidates connect are compared among each other, and only pairs
whose sets of shingles have the similarity, checked exactly, are links. Sixteen classes are asked
for at most, so a pair can be missed that has no class in common and no chain of candidates.

Equal fingerprints (of wide ones: equal sets of shingles) are one class from the start and copies
are never paired. Cases: a null or
blank text has the fingerprint zero, linked like any other; null ids count as larger than all
others; repeated rows are all in one group; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import column, free_name, small_batches
from tallystone.llm.components import components
from tallystone.session import stored

SEED = 42
RADIUS = 3
SEGMENTS = 4

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 8  # 64-bit words of a wide fingerprint
CLASS_SIZE = 3  # shingles expected in a class
ASKED = 16  # classes of a document that are asked for
DEVIATIONS = 7  # room of the radius: four, and ties of texts with few shingles
HOT = 4096  # fingerprints under one key in a block; a task compares two blocks at most
BLOCK = 256  # the same for sets of shingles
SLICE = 1 << 15  # shingles hashed at a time

_ODD = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """Hashes of all k-word shingles of a text, in slices; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    last = max(1, len(words) - k + 1)
    for at in range(0, last, SLICE):
        part = words[at : min(at + SLICE, last) + k - 1]
        if len(words) <= k:
            shingles = [b" ".join(part)]
        else:
            shingles = [b" ".join(s) for s in zip(*(part[i:] for i in range(k)))]
        yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of unsigned words; bit 0 is the lowest of the first word."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")
    counts = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):  # sums of 255 rows fit into a byte
        counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return counts


def _packed(set_bits: np.ndarray) -> bytes:
    return np.packbits(set_bits, bitorder="little").tobytes()


def fingerprint(text: str | None, k: int = 3) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, k):
        counts += bit_counts(hashes.reshape(-1, 1))
        n += len(hashes)
    return int.from_bytes(_packed(2 * counts > n), "little", signed=True)


def fingerprints(text: Column, k: int = 3) -> Column:
    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return of(text)


def _turned(value: Column, by: int) -> Column:
    return value if by == 0 else F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def _ring_keys(value: Column, flips: bool) -> Column:
    """Per start on the ring: the first two segments, also with each bit of the second turned."""
    keys = []
    for i in range(SEGMENTS):
        two = F.shiftrightunsigned(_turned(value, 16 * i), 32)
        tag = F.lit(i << 32)
        keys += [tag.bitwiseOR(two.bitwiseXOR(F.lit(bit))) for bit in ([0, *(1 << b for b in range(16))] if flips else [0])]
    return F.array(*keys)


def _chain_holds() -> Column:
    """Budgets of the chain that starts where the keys were equal."""
    diff = F.col("x").bitwiseXOR(F.col("y"))
    start = F.shiftrightunsigned(F.col("key"), 32)
    turned = F.lit(0).cast("long")
    for i in range(SEGMENTS - 1, -1, -1):
        turned = F.when(start == i, _turned(diff, 16 * i)).otherwise(turned)
    holds = F.lit(True)
    for length in range(1, SEGMENTS + 1):
        holds &= F.bit_count(F.shiftrightunsigned(turned, 64 - 16 * length)) <= length * RADIUS // SEGMENTS
    return holds


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b) of the distinct 64-bit fingerprints ``fp`` at RADIUS bits or fewer."""
    asked = distinct.select(F.col("fp").alias("x"), F.explode(_ring_keys(F.col("fp"), True)).alias("key"))
    found = distinct.select(F.col("fp").alias("y"), F.explode(_ring_keys(F.col("fp"), False)).alias("key"))
    return asked.join(found, "key").where((F.col("x") < F.col("y")) & _chain_holds()).select(F.col("x").alias("a"), F.col("y").alias("b"))


def linked(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id that links lead to)."""
    small_batches(docs.sparkSession)
    prints = stored(docs.select("doc_id", fingerprints(F.col("text"), k).alias("fp")), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    grouped = distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    return (
        prints.join(grouped.select("fp", "label").join(least, "label"), "fp")
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def _mix(values: np.ndarray, odd: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = values * np.uint64(odd)
        x ^= x >> np.uint64(31)
        return x * np.uint64(_ODD[0])


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, k)]))


def signature(text: str | None, k: int = SHINGLE) -> tuple[bytes, list[int]]:
    """Wide fingerprint of the set of shingles, with a hash of the set behind it, and the keys of
    its classes."""
    hashes = shingle_set(text, k)
    if not len(hashes):
        return bytes(8 * WORDS + 8), [0]
    n, counts = len(hashes), np.zeros(64 * WORDS, np.int64)
    for at in range(0, n, SLICE):
        part = hashes[at : at + SLICE]
        counts += bit_counts(np.stack([_mix(part, odd) for odd in _ODD], axis=1))
    keys: list[int] = []
    mixed, size = _mix(hashes, 0xD1342543DE82EF95), math.log2(max(n / CLASS_SIZE, 1))
    # alike texts may differ in size by the factor SIMILARITY: near a border both class counts are asked
    reach = 0.5 - math.log2(SIMILARITY) / 2
    for bits in range(max(1, math.ceil(size - reach)), max(1, math.floor(size + reach)) + 1):
        of = (mixed >> np.uint64(64 - bits)).astype(np.int64)
        inside = of < ASKED
        sums = np.zeros(ASKED, np.uint64)
        np.add.at(sums, of[inside], _mix(mixed[inside], 0x2545F4914F6CDD1D))
        for c in np.unique(of[inside]):
            keys.append(xxhash.xxh64_intdigest(b"%d %d %d" % (bits, c, sums[c]), SEED))
    return _packed(2 * counts > n) + xxhash.xxh64_digest(hashes.tobytes(), SEED), [k - (1 << 64) if k >= 1 << 63 else k for k in keys]


def signatures(text: Column, k: int = SHINGLE) -> Column:
    @F.pandas_udf("fp binary, keys array<bigint>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signature(t, k) for t in texts], columns=["fp", "keys"])

    return of(text)


def shingle_sets(text: Column, k: int = SHINGLE) -> Column:
    @F.pandas_udf(T.BinaryType())
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t, k).tobytes())

    return of(text)


def wide_radius(similarity: float = SIMILARITY) -> int:
    """Bits that hardly any pair of sets with that Jaccard similarity exceeds: the mean of sets of
    equal size, and DEVIATIONS."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(64 * WORDS * share + DEVIATIONS * math.sqrt(64 * WORDS * share * (1 - share)))


def alike(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Whether two sets have the Jaccard similarity."""
    small, large = sorted((len(one), len(other)))
    if small < similarity * large - 1e-9:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both >= similarity * (small + large - both) - 1e-9


def _linked(batches: Iterator[pd.DataFrame], radius: int, similarity: float | None) -> Iterator[pd.DataFrame]:
    """Rows (part, fp and, with a similarity, set) sorted by part: each fingerprint is compared with
    all earlier ones of its part. Links come out that join two trees of the part."""
    current, n = None, 0
    prints, trees = np.zeros((64, WORDS), np.uint64), np.zeros(64, np.int64)
    names: list[bytes] = []
    sets: list[np.ndarray] = []
    for batch in batches:
        out = []
        for part, fp, *own in batch.itertuples(index=False):
            if part != current:
                current, n, names, sets = part, 0, [], []
            if n == len(prints):
                prints, trees = np.concatenate([prints, prints]), np.concatenate([trees, trees])
            prints[n], trees[n] = np.frombuffer(fp, "<u8")[:WORDS], n
            names.append(fp)
            if similarity is not None:
                sets.append(np.frombuffer(own[0], np.uint64))
            bits = np.bitwise_count(prints[:n] ^ prints[n]).sum(axis=1, dtype=np.int64)
            hits = np.flatnonzero(bits <= radius)
            hits = hits[np.argsort(bits[hits], kind="stable")]
            while len(hits):
                i, hits = hits[0], hits[1:]
                if similarity is None or alike(sets[i], sets[n], similarity):
                    out.append((fp, names[i]))
                    trees[:n][trees[:n] == trees[i]] = n
                    hits = hits[trees[hits] != n]
            n += 1
        yield pd.DataFrame(out, columns=["a", "b"])


def _links(rows: DataFrame, of: str, size: int, radius: int, similarity: float | None = None) -> DataFrame:
    """Links within each group of ``rows`` (column ``of``, fp, set). A group of more than ``size``
    rows is dealt into blocks, and each two blocks meet in a task."""
    shared = rows.groupBy(of).agg(F.count("fp").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / size)
    dealt = rows.join(shared, of).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 OR block != other")
    part = F.xxhash64(of, F.least("block", "other"), F.greatest("block", "other")).alias("part")
    own = ["set"] if similarity is not None else []
    parts = met.select(part, "fp", *own).repartition("part").sortWithinPartitions("part", "fp")
    return parts.mapInPandas(lambda batches: _linked(batches, radius, similarity), "a binary, b binary").distinct()


def candidates(distinct: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect what is within the radius under a key of the distinct signatures
    (fp, keys). Per key they are fewer than its fingerprints."""
    return _links(distinct.select("fp", F.explode("keys").alias("key")), "key", HOT, wide_radius(similarity))


def similar(grouped: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect all pairs of the similarity within the groups (label, fp, set)."""
    return _links(grouped, "label", BLOCK, wide_radius(similarity), similarity)


def ring_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all ``fp`` whose 64-bit fingerprints ``print`` are at RADIUS bits or fewer."""
    prints = prints.select("fp", "print").distinct()
    first = stored(prints.groupBy("print").agg(F.min("fp").alias("first")), "prints")
    near = links(first.select(F.col("print").alias("fp")))
    one, other = (first.select(F.col("print").alias(end), F.col("first").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    across = near.join(one, "a").join(other, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return across.unionByName(prints.join(first, "print").select(F.col("fp").alias("a"), F.col("first").alias("b")))


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, ring: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest doc_id, then the smallest
    hash of the text. All columns stay. With ``ring``, fingerprints within RADIUS bits are links too."""
    small_batches(docs.sparkSession)
    id_, text = column(docs, "doc_id"), column(docs, "text")
    last = F.lit((1 << 63) - 1)
    signed = docs.select(F.coalesce(id_, last).alias("id"), F.xxhash64(text).alias("h"), *([fingerprints(text).alias("print")] if ring else []), signatures(text, k).alias("s"))
    signed = stored(signed.select("id", "h", *(["print"] if ring else []), "s.*"), "signatures")
    first = F.min(F.struct("id", "h")).alias("first")
    distinct = stored(signed.groupBy("fp").agg(first, F.any_value("keys").alias("keys")), "distinct")
    maybe = components(candidates(distinct.select("fp", "keys"), similarity)).withColumnRenamed("node", "fp")
    places = distinct.join(maybe, "fp").select("label", "fp", F.col("first.id").alias("id"), F.col("first.h").alias("h"))
    texts = docs.select(F.coalesce(id_, last).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    found = places.join(texts, ["id", "h"])
    grouped = stored(found.select("label", "fp", shingle_sets(F.col("text"), k).alias("set")), "sets")
    found = similar(grouped, similarity)
    label = components(found.unionByName(ring_links(signed)) if ring else found).withColumnRenamed("node", "fp")
    kept = distinct.select("fp", "first").join(label, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first"))
    names = [free_name(docs, n) for n in ("_id", "_h", "_n")]
    wanted = kept.select(F.col("first.id").alias(names[0]), F.col("first.h").alias(names[1]))
    keyed = docs.withColumns({names[0]: F.coalesce(id_, last), names[1]: F.xxhash64(text)}).join(wanted, names[:2], "left_semi")
    one = F.row_number().over(Window.partitionBy(*names[:2]).orderBy(*names[:2]))
    kept_rows = keyed.withColumn(names[2], one).where(F.col(names[2]) == 1)
    return kept_rows.select(*(column(kept_rows, c) for c in docs.columns))
