"""Embedding near-dedup by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted independently on a bounded sample; their
product is a grid of cells, and every vector lies in the cell of its nearest codewords. A vector visits
cells by multi-sequence traversal: the two lists of codewords, sorted by distance, are merged so that cells
come in order of their distance sum, and the traversal stops where that sum exceeds the sum of
the own cell by more than a radius. The radius is calibrated: pairs at exactly the threshold are made
around sample vectors (in random directions and towards other sample vectors), linked pairs of the sample join
them, and the radius is the largest excess by which the target share of them is found. Of two
cells only the lesser one's vectors visit the other, so a pair is looked at once. What meets in a cell
is verified by its cosine in double precision.

Hot groups: equal unit vectors are one vector with a count. Dense regions of the sample become balls of half the
threshold's angle: all members of a ball are linked with each other, which needs no comparison, so a ball of any
size is never compared with itself. What is left of a cell is cut into blocks of ``BLOCK`` vectors that
others stream past. Tasks give back counts and the links that join two trees of a block, never all pairs.

Bounds: the codebooks have at most ``MOST_CODEWORDS`` words each and the sample ``FIT_ROWS`` vectors; neither
limits what is compared.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing; shorter vectors
are filled up with zeros; rows that repeat an id are vectors of their own; null ids count as vectors but are
never the smallest id of a component unless it has no other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import small_batches
from tallystone.llm.components import components
from tallystone.session import stored

THRESHOLD = 0.9
#: Share of the pairs at the very threshold that the traversal is to find; closer pairs are found more often.
RECALL = 0.99
FIT_ROWS = 8192
MOST_CODEWORDS = 256
CELL_ROWS = 256
BLOCK = 2048
#: A ball holds at least this share of the sample.
DENSE = 1 / 128
SEED = 11

_MARGIN = 1e-9


def unit(values: list[float | None] | None, width: int) -> np.ndarray | None:
    """The unit vector in double precision, or None where there is none."""
    if not values or None in values:
        return None
    vector = np.zeros(width)
    vector[: len(values)] = values
    largest = np.abs(vector).max()
    if not np.isfinite(largest) or largest == 0:
        return None
    vector /= largest
    return vector / np.sqrt(vector @ vector)


def codebook(points: np.ndarray, words: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's codewords, begun at points far from those chosen before."""
    chosen = [points[rng.integers(len(points))]]
    nearest = ((points - chosen[0]) ** 2).sum(1)
    while len(chosen) < words and nearest.sum() > 0:
        chosen.append(points[rng.choice(len(points), p=nearest / nearest.sum())])
        nearest = np.minimum(nearest, ((points - chosen[-1]) ** 2).sum(1))
    centers = np.array(chosen)
    for _ in range(rounds):
        owner = distances(points, centers).argmin(1)
        for word in range(len(centers)):
            if (own := owner == word).any():
                centers[word] = points[own].mean(0)
    return centers


def distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centers."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)[None, :], 0)


def traversal(first: np.ndarray, second: np.ndarray, radius: float) -> Iterator[tuple[int, int]]:
    """Cells in order of ``first[i] + second[j]``, up to ``radius`` beyond the nearest one."""
    rows, columns = first.argsort(kind="stable"), second.argsort(kind="stable")
    a, b = first[rows].tolist(), second[columns].tolist()
    limit = a[0] + b[0] + radius
    heap = [(a[0] + b[0], 0, 0)]
    while heap and heap[0][0] <= limit:
        _, i, j = heappop(heap)
        yield int(rows[i]), int(columns[j])
        if j + 1 < len(b):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heappush(heap, (a[i + 1] + b[0], i + 1, 0))


@dataclass(frozen=True)
class Index:
    """Codebooks of both halves, the traversal's radius and the centers of dense balls."""

    first: np.ndarray
    second: np.ndarray
    radius: float
    balls: np.ndarray
    threshold: float

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return distances(points[:, :cut], self.first), distances(points[:, cut:], self.second)

    def cells(self, points: np.ndarray) -> np.ndarray:
        first, second = self.halves(points)
        return first.argmin(1) * len(self.second) + second.argmin(1)

    def ball_of(self, points: np.ndarray) -> np.ndarray:
        """The first ball around each point, -1 for none."""
        if not len(self.balls):
            return np.full(len(points), -1)
        inside = points @ self.balls.T >= _ball_cosine(self.threshold)
        return np.where(inside.any(1), inside.argmax(1), -1)


def _ball_cosine(threshold: float) -> float:
    """Cosine of half the threshold's angle: two vectors this near to a third one are linked."""
    return float(np.sqrt((1 + threshold) / 2)) + _MARGIN


def _partners(sample: np.ndarray, threshold: float, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and partners made at the very threshold; linked pairs of the sample."""
    x = sample[rng.integers(len(sample), size=2048)]
    towards = np.where((np.arange(len(x)) % 2 == 0)[:, None], rng.normal(size=x.shape), sample[rng.integers(len(sample), size=len(x))])
    side = towards - (towards * x).sum(1)[:, None] * x
    length = np.sqrt((side**2).sum(1))
    x, side = x[length > 1e-6], side[length > 1e-6] / length[length > 1e-6][:, None]
    y = threshold * x + np.sqrt(1 - threshold**2) * side
    few = sample[:2048]
    i, j = np.nonzero(np.triu(few @ few.T >= threshold, 1))
    return [(x, y), (few[i], few[j])]


def fitted(sample: np.ndarray, words: int, threshold: float, recall: float, seed: int = SEED) -> Index:
    """The index of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    cut = (sample.shape[1] + 1) // 2
    index = Index(codebook(sample[:, :cut], words, rng), codebook(sample[:, cut:], words, rng), 0.0, np.zeros((0, sample.shape[1])), threshold)
    radius = 0.0
    for x, y in _partners(sample, threshold, rng):
        if len(x):
            first, second = index.halves(x)
            i, j = divmod(index.cells(y), len(index.second))
            at = np.arange(len(x))
            radius = max(radius, float(np.quantile(first[at, i] + second[at, j] - first.min(1) - second.min(1), recall)))
    near = sample @ sample[:1024].T >= _ball_cosine(threshold)
    balls, alive = [], np.ones(len(sample), bool)
    while (inside := near[alive].sum(0)).max() >= max(16, DENSE * len(sample)):
        balls.append(sample[inside.argmax()])
        alive &= ~near[:, inside.argmax()]
        if not alive.any():
            break
    return Index(index.first, index.second, radius + _MARGIN, np.array(balls).reshape(len(balls), sample.shape[1]), threshold)


@dataclass(frozen=True)
class Layout:
    """The groups of each cell: (group, ball) pairs, and the first group and number of blocks per cell and ball."""

    groups: dict[int, list[tuple[int, int]]]
    own: dict[tuple[int, int], tuple[int, int]]

    @staticmethod
    def of(counts: list[tuple[int, int, int]], block: int) -> Layout:
        groups: dict[int, list[tuple[int, int]]] = {}
        own, number = {}, 0
        for cell, ball, n in sorted(counts):
            blocks = -(-n // block)
            own[cell, ball] = number, blocks
            groups.setdefault(cell, []).extend((g, ball) for g in range(number, number + blocks))
            number += blocks
        return Layout(groups, own)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(-1, width)


def _units(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [unit(v, width) for v in batch.column(2).to_pylist()]
            data = [None if v is None else (v + 0.0).tobytes() for v in made]  # adding zero makes -0.0 and 0.0 one
            keys = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["row", "vec_id", "key", "unit"])

    return rows


def _assigned(index: Index, width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("unit"), width)
                columns = [batch.column("rep"), batch.column("n"), pa.array(index.cells(points), pa.int32()), pa.array(index.ball_of(points), pa.int32()), batch.column("unit")]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "cell", "ball", "unit"])

    return rows


def _routed(index: Index, layout: Layout, width: int):
    """Each vector as a member of its own group and as a visitor of the groups it is compared with."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = index.halves(_matrix(batch.column("unit"), width))
            groups, visitor, source = [], [], []
            for at, (rep, cell, ball) in enumerate(zip(*(batch.column(name).to_pylist() for name in ("rep", "cell", "ball")))):
                start, blocks = layout.own[cell, ball]
                mine = start + rep * 2654435761 % 2**32 % blocks
                asked = [g for g, other in layout.groups[cell] if g < mine and (ball < 0 or other != ball)]
                for i, j in traversal(first[at], second[at], index.radius):
                    there = i * len(index.second) + j
                    if there > cell and there in layout.groups:
                        asked += [g for g, other in layout.groups[there] if ball < 0 or other != ball]
                groups += [mine, *asked]
                visitor += [0] + [1] * len(asked)
                source += [at] * (1 + len(asked))
                if len(groups) > 4096:
                    yield part(batch, groups, visitor, source)
                    groups, visitor, source = [], [], []
            if groups:
                yield part(batch, groups, visitor, source)

    def part(batch: pa.RecordBatch, groups: list[int], visitor: list[int], source: list[int]) -> pa.RecordBatch:
        taken = batch.select(["rep", "n", "ball", "unit"]).take(pa.array(source))
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(visitor, pa.int32()), *taken.columns], names=["group", "visitor", "rep", "n", "ball", "unit"])

    return rows


class _Members:
    """The members of a group, what links them so far, and how many vectors each is linked with."""

    def __init__(self, width: int, threshold: float) -> None:
        self.width, self.threshold = width, threshold
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.reps: np.ndarray | None = None

    def extend(self, reps: np.ndarray, n: np.ndarray, points: np.ndarray, ball: int) -> None:
        self.parts.append((reps, n, points))
        self.ball = ball

    def close(self) -> list[tuple[int, int | None, int | None]]:
        """All members are here: link them among themselves (a ball's are linked already)."""
        self.reps, self.n, self.points = (np.concatenate(x) for x in zip(*self.parts))
        self.links, self.tree = np.zeros(len(self.reps), np.int64), np.arange(len(self.reps))
        if self.ball >= 0:
            return []
        found = []
        for low in range(0, len(self.reps), 512):
            hits = np.triu(self.points[low : low + 512] @ self.points.T >= self.threshold, 1 + low)
            self.links += self.n[low : low + 512] @ hits
            self.links[low : low + 512] += hits @ self.n
            for i in np.flatnonzero(hits.any(1)):
                found += self.join(np.append(np.flatnonzero(hits[i]), low + i))
        return found

    def join(self, places: np.ndarray) -> list[tuple[int, int, None]]:
        """The links that make one tree of the trees of linked members."""
        trees, first = np.unique(self.tree[places], return_index=True)
        if len(trees) > 1:
            self.tree[np.isin(self.tree, trees)] = trees[0]
        return [(int(self.reps[places[first[0]]]), int(self.reps[places[i]]), None) for i in first[1:]]

    def visit(self, reps: np.ndarray, n: np.ndarray, points: np.ndarray) -> list[tuple[int, int | None, int | None]]:
        found: list[tuple[int, int | None, int | None]] = []
        hits = points @ self.points.T >= self.threshold
        self.links += n @ hits
        for i in np.flatnonzero(hits.any(1)):
            places = np.flatnonzero(hits[i])
            found += [(int(reps[i]), None, int(self.n[places].sum())), (int(reps[i]), int(self.reps[places[0]]), None)]
            if self.ball < 0:
                found += self.join(places)
        return found

    def counted(self) -> list[tuple[int, None, int]]:
        return [(int(self.reps[i]), None, int(self.links[i])) for i in np.flatnonzero(self.links)]


def _verified(threshold: float, width: int):
    """Counts (a, null, n) and links (a, b, null) of groups whose members come before their visitors."""

    def pack(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, out = None, None, []
        for batch in batches:
            keys, visitor = (batch.column(name).to_numpy() for name in ("group", "visitor"))
            reps, n, ball = (batch.column(name).to_numpy() for name in ("rep", "n", "ball"))
            points = _matrix(batch.column("unit"), width)
            borders = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(visitor) != 0)) + 1).tolist(), len(keys)]
            for low, high in zip(borders, borders[1:]):
                if low == high:
                    continue
                if keys[low] != group:
                    if members is not None:
                        out += (members.close() if members.reps is None else []) + members.counted()
                    group, members = keys[low], _Members(width, threshold)
                if not visitor[low]:
                    members.extend(reps[low:high], n[low:high], points[low:high], int(ball[low]))
                    continue
                if members.reps is None:
                    out += members.close()
                out += members.visit(reps[low:high], n[low:high], points[low:high])
                if len(out) > 10_000:
                    yield pack(out)
                    out = []
        if members is not None:
            out += (members.close() if members.reps is None else []) + members.counted()
        if out:
            yield pack(out)

    return rows


def linked(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, codewords: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row (vec_id, embedding)."""
    small_batches(vectors.sparkSession)
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = stored(rows.mapInArrow(_units(max(width, 1)), "row long, vec_id long, key binary, unit binary"), "vectors")
    copies = base.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.any_value("unit").alias("unit")
    )
    copies = stored(copies, "copies")
    sample = copies.orderBy("key").limit(FIT_ROWS).select("unit").collect()  # bounded; keys are digests, so their order is random
    if not sample:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    total = copies.count()
    words = codewords or int(min(MOST_CODEWORDS, max(2, round((total / CELL_ROWS) ** 0.5))))
    index = fitted(np.frombuffer(b"".join(r.unit for r in sample), np.float64).reshape(len(sample), width), words, threshold, recall)
    placed = copies.select("rep", "n", "unit").mapInArrow(_assigned(index, width), "rep long, n long, cell int, ball int, unit binary")
    placed = stored(placed, "placed")
    counts = placed.groupBy("cell", "ball").agg(F.count(F.lit(1)).alias("rows")).collect()  # at most cells times balls
    layout = Layout.of([tuple(r) for r in counts], block)
    routed = placed.mapInArrow(_routed(index, layout, width), "group long, visitor int, rep long, n long, ball int, unit binary")
    found = routed.repartition("group").sortWithinPartitions("group", "visitor").mapInArrow(_verified(threshold, width), "a long, b long, n long")
    found = stored(found, "links")
    balls = placed.where(F.col("ball") >= 0).groupBy("ball").agg(F.sum("n").alias("inside"), F.min("rep").alias("head"))  # few rows
    in_balls = placed.join(F.broadcast(balls), "ball").select("rep", "head", (F.col("inside") - F.col("n")).alias("more"))
    edges = found.where(F.col("b").isNotNull()).select("a", "b").unionByName(in_balls.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    component = components(edges)
    links = found.where(F.col("b").isNull()).select("a", "n").unionByName(in_balls.select(F.col("rep").alias("a"), F.col("more").alias("n"))).groupBy("a").agg(F.sum("n").alias("n"))
    known = copies.select("key", "rep", F.col("n").alias("copies"), "least")
    known = known.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = stored(known.select("key", "least", F.coalesce("label", "rep").alias("label"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    smallest = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "label").select("key", "n_links", "component_id")
    out = base.select("vec_id", "key").join(known, "key", "left")
    component_id = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))


#: DuckDB: every pair.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::double[] AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
  FROM embeddings
), links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r WHERE a.good AND b.good AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
), reach AS (
  SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT reach.a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = v.r)::bigint AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN least ON least.a = v.r
"""
