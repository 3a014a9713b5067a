"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over the edit lattice.

The lattice of a conversation has a layer per turn and in each layer four states: nothing said yet, a
system turn said, a user turn said last, an assistant turn said last. Keep, Rerole and Delete lead
from a layer to the next, Insert stays in its layer. A forward heap from the start and a reverse heap from
both allowed ends meet; the search goes on until no unseen crossing can cost as little as the best
one, and the least audit (the edits' initials) among all crossings of that cost is taken. Heaps are
ordered by cost and then by layer, so what costs nothing is settled in order and the audits kept with the
nodes are the least ones.

Rows are sorted by conversation and turn over ranges, so a conversation of any length is spread over tasks. One that lies
within a range is repaired there. The others go on in fragments: of each fragment the cheapest way between any two states is
found (blocks of ``BLOCK`` turns at a time), the fragments' ways are the steps of one more lattice, and the chosen
audit is dealt back to the fragments. Only the last digest must see the turns of a conversation one after
another; it streams over them.

Cases: a null id, role or text counts as one space, rows without a turn come first; rows of one turn
are in order of role and then of the MD5 of their text; repeated rows are turns of their own (the later ones
duplicates); a conversation that loses all rows has zeros, an empty audit and the digest of an empty
text; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallystone.llm.common import small_batches
from tallystone.session import stored

#: Edits and their costs, fault names in order of precedence.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
LEFT_TRUNCATED = 1
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"

#: States: nothing said, system said, user said last, assistant said last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
GOALS = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
BEFORE = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns that one search spans; longer runs are searched block by block.
BLOCK = 256

_SPACE = " \t\n\v\f\r"
_LEGAL = {"su", "ua", "au"}

#: An edge of a step: from state, to state, cost, audit.
Edge = tuple[int, int, int, str]
_INSERTS: list[Edge] = [(p, q, COST[INSERT], INSERT) for q in NAMES for p in BEFORE[q]]


def turn_edges(initial: str, fault: str | None) -> list[Edge]:
    """What can be done with a turn."""
    edges = [(q, q, COST[DELETE], DELETE) for q in STATES]
    if fault in (BLANK, DUPLICATE):
        return edges
    rest = LEFT_TRUNCATED if fault == TRUNCATED else 0
    said = INITIALS.get(initial)
    if said is not None:
        edges += [(p, said, COST[KEEP] + rest, KEEP) for p in BEFORE[said]]
    return edges + [(p, q, COST[REROLE] + rest, REROLE) for q in NAMES for p in BEFORE[q]]


class _Side:
    """One of the two searches: its heap, the labels found and the nodes settled. ``way`` is 1 or -1."""

    def __init__(self, way: int, nodes: Iterable[tuple[int, int]]) -> None:
        self.way, self.labels, self.settled = way, {node: (0, "") for node in nodes}, set()
        self.ends = set(self.labels)
        self.heap: list[tuple[int, int, int]] = []
        for layer, state in self.labels:
            heappush(self.heap, (0, way * layer, state))

    def least(self) -> float:
        while self.heap and (self.way * self.heap[0][1], self.heap[0][2]) in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def pop(self) -> tuple[int, int]:
        _, layer, state = heappop(self.heap)
        node = (self.way * layer, state)
        self.settled.add(node)
        return node

    def relax(self, node: tuple[int, int], cost: int, audit: str) -> None:
        if node not in self.settled and (cost, audit) < self.labels.get(node, (float("inf"), "")):
            self.labels[node] = (cost, audit)
            heappush(self.heap, (cost, self.way * node[0], node[1]))


def search(steps: list[list[Edge]], starts: Iterable[int], goals: Iterable[int], inserts: list[Edge] = _INSERTS) -> tuple[int, str] | None:
    """Least cost and least audit of that cost from ``starts`` before the steps to ``goals`` after them."""
    last = len(steps)
    ahead, back = _Side(1, [(0, q) for q in starts]), _Side(-1, [(last, q) for q in goals])

    def edges(side: _Side, node: tuple[int, int]) -> Iterator[tuple[tuple[int, int], int, str]]:
        layer, state = node
        near, far = (0, 1) if side is ahead else (1, 0)
        for edge in inserts:
            if edge[near] == state:
                yield (layer, edge[far]), edge[2], edge[3]
        step = layer if side is ahead else layer - 1
        if 0 <= step < last:
            for edge in steps[step]:
                if edge[near] == state:
                    yield (layer + side.way, edge[far]), edge[2], edge[3]

    best = float("inf")
    while True:
        low = ahead.least(), back.least()
        if ahead.settled and back.settled and (sum(low) > best or min(low) == float("inf")):
            break
        side, other = (ahead, back) if not ahead.settled or back.settled and low[0] <= low[1] else (back, ahead)
        node = side.pop()
        cost, audit = side.labels[node]
        if node in other.labels:
            best = min(best, cost + other.labels[node][0])
        for after, price, letter in edges(side, node):
            side.relax(after, cost + price, audit + letter if side is ahead else letter + audit)
            if after in other.labels:
                best = min(best, cost + price + other.labels[after][0])
    if best == float("inf"):
        return None
    # the ends of a search have their final label from the outset
    near, far = ahead.settled | ahead.ends, back.settled | back.ends
    crossings = [ahead.labels[n][1] + back.labels[n][1] for n in near & far if ahead.labels[n][0] + back.labels[n][0] == best]
    for node in near:
        cost, audit = ahead.labels[node]
        for after, price, letter in edges(ahead, node):
            if after in far and cost + price + back.labels[after][0] == best:
                crossings.append(audit + letter + back.labels[after][1])
    return int(best), min(crossings)


def ways(steps: list[list[Edge]], block: int = BLOCK) -> list[Edge]:
    """The steps as one: the cheapest way between any two states, least audit first."""
    found = _in_blocks(steps, block)
    inserts = _INSERTS if found is steps else []
    every = ((p, q, search(found, [p], [q], inserts)) for p in STATES for q in STATES)
    return [(p, q, *way) for p, q, way in every if way is not None]


def _in_blocks(steps: list[list[Edge]], block: int) -> list[list[Edge]]:
    """Steps of at most ``block`` turns each; fewer turns than that stay as they are."""
    if len(steps) <= block:
        return steps
    return [ways(steps[i : i + block], block) for i in range(0, len(steps), block)]


def cheapest(steps: list[list[Edge]], block: int = BLOCK) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    found = _in_blocks(steps, block)
    answer = search(found, [START], GOALS, _INSERTS if found is steps else [])
    assert answer is not None  # deleting every turn is always a way
    return answer


def fault_of(text: str, repeated: bool) -> str | None:
    said = text.strip(_SPACE)
    if not said:
        return BLANK
    if repeated:
        return DUPLICATE
    return None if said[-1] in ".!?" else TRUNCATED


def repaired(audit: Iterable[str], turns: Iterable[tuple[str, str]], state: int = START) -> Iterator[tuple[int, str, str]]:
    """States, roles and texts of the repaired conversation from its audit and its (role, text) turns."""
    turns = iter(turns)
    for edit in audit:
        if edit == DELETE:
            next(turns)
            continue
        role, text = ("", "") if edit == INSERT else next(turns)
        if edit == KEEP:
            state = INITIALS[role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = NAMES[state]
        yield state, role, text


class _Digest:
    """SHA-256 of lines joined by newlines."""

    def __init__(self) -> None:
        self.hash, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage; a dropped row stays as a mark that its conversation exists."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select(
        "conv_id", "turn", F.when(lot == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (lot == 0).alias("gone"),
        F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [field.split()[0] for field in _COUNTS.split(", ")]


def _whole(rows: list[tuple], block: int) -> tuple[tuple, list[tuple[str, str]]]:
    """The result of a conversation from its (turn, role, text) rows in order, and its repaired turns."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for _, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    cost, audit = cheapest([turn_edges(role[:1], fault) for (_, role, _), fault in zip(rows, faults)], block)
    digest, lines = _Digest(), [(role, text) for _, role, text in repaired(audit, ((role, text) for _, role, text in rows))]
    for line in lines:
        digest.add(*line)
    turns = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(name) for name in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, digest.hash.hexdigest()), lines


Batches = Iterator[pa.RecordBatch]


def _rows(batches: Batches) -> Iterator[tuple]:
    """Rows with their values as they are (pandas would make large integers beside nulls inexact)."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _runs(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows, run by run of the same first value."""
    run: list[tuple] = []
    for row in rows:
        if run and run[0][0] != row[0]:
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Batches:
    while held := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*held), schema)], schema=schema)


def _mapped(df: DataFrame, function: Callable[[Batches], Iterator[tuple]], schema: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(function(batches), arrow), schema)


def _within(block: int, lines: bool) -> Callable[[Batches], Iterator[tuple]]:
    """Results (or repaired turns) of the conversations within a range; the rows of its first and last one, numbered, for the next step."""

    def rest(part: int, run: list[tuple]) -> Iterator[tuple]:
        for seq, (conv, turn, role, text, gone) in enumerate(run):
            yield (conv, *[None] * len(_NAMES), part, seq, turn, role, text, gone)

    def one(batches: Batches) -> Iterator[tuple]:
        part, first, before = TaskContext.get().partitionId(), True, None
        for run in _runs(_rows(batches)):
            if before is not None:
                if first:
                    yield from rest(part, before)
                else:
                    result, turns = _whole([row[1:4] for row in before if not row[4]], block)
                    if not lines:
                        yield (before[0][0], *result, *[None] * 6)
                    else:
                        yield from ((before[0][0], *[None] * len(_NAMES), None, k, None, *turn, None) for k, turn in enumerate(turns))
                first = False
            before = run
        if before is not None:
            yield from rest(part, before)

    return one


def _fragment(block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One fragment as a row: its faults, its ends' initials, and the cheapest ways through it."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seq")
        initials, faults = list(df["initial"]), [None if pd.isna(fault) else fault for fault in df["fault"]]
        through = [dict(zip(("p", "q", "cost", "audit"), way)) for way in ways([turn_edges(i, f) for i, f in zip(initials, faults)], block)]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        row = (df["conv_id"].iloc[0], df["part"].iloc[0], len(df), *(faults.count(n) for n in (BLANK, DUPLICATE, TRUNCATED)), illegal, initials[0], initials[-1], through)
        return pd.DataFrame([row], columns=["conv_id", "part", "n", BLANK, DUPLICATE, TRUNCATED, "illegal", "first", "last", "ways"])

    return one


def _joined(df: pd.DataFrame) -> pd.DataFrame:
    """The fragments of a conversation: one row with its counts and one row per fragment with its part of the audit."""
    df = df.sort_values("part")
    steps = [[(w["p"], w["q"], w["cost"], w["audit"]) for w in through] for through in df["ways"]]
    # few steps, but long audits: the lattice of ways goes through blocks like any other
    answer = search(_in_wide_blocks(steps), [START], GOALS, [])
    assert answer is not None
    cost, audit = answer
    illegal = int(df["illegal"].sum()) + sum(a + b not in _LEGAL for a, b in zip(df["last"][:-1], df["first"][1:]))
    conv = df["conv_id"].iloc[0]
    rows = [(conv, None, *(int(df[n].sum()) for n in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit)]
    at = 0
    for k, (part, n) in enumerate(zip(df["part"], df["n"])):
        end = at
        while n:
            n -= audit[end] != INSERT
            end += 1
        end = len(audit) if k == len(df) - 1 else end
        rows.append((conv, part, None, None, None, None, None, audit[at:end]))
        at = end
    return pd.DataFrame(rows, columns=["conv_id", "part", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "audit"], dtype=object)


def _in_wide_blocks(steps: list[list[Edge]], width: int = 16) -> list[list[Edge]]:
    while len(steps) > width:
        groups = [steps[i : i + width] for i in range(0, len(steps), width)]
        steps = [[(p, q, *way) for p in STATES for q in STATES if (way := search(g, [p], [q], [])) is not None] for g in groups]
    return steps


def _digests(lines: bool) -> Callable[[Batches], Iterator[tuple]]:
    """One digest per conversation (or its repaired turns), from its fragments' audits and turns in order."""

    def one(batches: Batches) -> Iterator[tuple]:
        current, digest, state, number, edits = None, None, START, 0, iter(())

        def said(mine: Iterable[str], turns: list[tuple[str, str]]) -> Iterator[tuple]:
            nonlocal state, number
            for state, role, text in repaired(mine, turns, state):
                digest.add(role, text)
                if lines:
                    yield current, None, number, role, text
                number += 1

        def finished() -> Iterator[tuple]:
            yield from said(list(edits), [])  # what is left of an audit are insertions
            if not lines:
                yield current, digest.hash.hexdigest(), None, None, None

        for conv, _, _, role, text, audit in _rows(batches):
            if digest is None or conv != current:
                if digest is not None:
                    yield from finished()
                current, digest, state, number, edits = conv, _Digest(), START, 0, iter(())
            if audit is not None:
                yield from said(list(edits), [])
                edits = iter(audit)
                continue
            mine = []
            for edit in edits:
                mine.append(edit)
                if edit != INSERT:
                    break
            yield from said(mine, [(role, text)])
        if digest is not None:
            yield from finished()

    return one


def _conversations(rows: DataFrame, partitions: int | None, block: int, lines: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    kind, turn = (rows.schema[name].dataType.simpleString() for name in ("conv_id", "turn"))
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_tie", "_row"]
    rows = rows.select("conv_id", "turn", space("role"), space("text"), gone.alias("gone"))
    rows = rows.select("*", F.md5(F.col("text").cast("binary")).alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")
    schema = f"conv_id {kind}, {_COUNTS}, part int, seq long, turn {turn}, role string, text string, gone boolean"
    found = stored(_mapped(ranged, _within(block, lines), schema), "conversations")
    names = ["seq", "role", "text"] if lines else _NAMES
    done = found.where(F.col("part").isNull()).select("conv_id", *names)
    return done.unionByName(_over_ranges(found.where(F.col("part").isNotNull()), kind, block, lines))


def _over_ranges(open_rows: DataFrame, kind: str, block: int, lines: bool) -> DataFrame:
    """Results of the conversations at the borders of ranges, fragment by fragment."""
    rows = open_rows.where(~F.col("gone")).select("conv_id", "part", "seq", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("h"))
    firsts = rows.groupBy("conv_id", "role", "h").agg(F.min(F.struct("part", "seq")).alias("first")).alias("f")
    r = rows.alias("r")
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.role") == F.col("f.role")) & (F.col("r.h") == F.col("f.h"))
    said = F.btrim("r.text", F.lit(_SPACE))
    fault = (
        F.when(said == "", BLANK).when(F.struct("r.part", "r.seq") > F.col("f.first"), DUPLICATE).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    )
    judged = r.join(firsts, same).select("r.conv_id", "r.part", "r.seq", F.left("r.role", F.lit(1)).alias("initial"), fault.alias("fault"))
    counts = f"{BLANK} long, {DUPLICATE} long, {TRUNCATED} long, illegal long"
    way = "ways array<struct<p:int,q:int,cost:long,audit:string>>"
    fragments = judged.groupBy("conv_id", "part").applyInPandas(_fragment(block), f"conv_id {kind}, part int, n long, {counts}, first string, last string, {way}")
    joined = stored(fragments.groupBy("conv_id").applyInPandas(_joined, f"conv_id {kind}, part int, {counts}, cost long, audit string"), "audits")
    no = F.lit(None).cast("string")
    edits = joined.where(F.col("part").isNotNull()).select("conv_id", "part", F.lit(-1).cast("long").alias("seq"), no.alias("role"), no.alias("text"), "audit")
    streamed = rows.select("conv_id", "part", "seq", "role", "text", no.alias("audit")).unionByName(edits)
    streamed = streamed.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    ends = _mapped(streamed, _digests(lines), f"conv_id {kind}, repaired_sha256 string, seq long, role string, text string")
    if lines:
        return ends.select("conv_id", "seq", "role", "text")
    ids = open_rows.select("conv_id").distinct()
    turns = rows.where(F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    spans = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).cast("long").alias("gaps"))
    out = ids
    for more in (joined.where(F.col("part").isNull()).drop("part"), spans, ends.select("conv_id", "repaired_sha256")):
        more = more.withColumnRenamed("conv_id", "_id")
        out = out.join(more, out["conv_id"].eqNullSafe(more["_id"]), "left").drop("_id")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return out.select(
        "conv_id", *(zero(n) for n in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def repairs(conversations: DataFrame, partitions: int | None = None, block: int = BLOCK) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation.

    Rows hold conv_id, turn, role and text, and may say ``gone``: such a row only tells that its conversation exists.
    ``partitions`` is the number of ranges (else the session's shuffle partitions), ``block`` the turns of one search."""
    return _conversations(conversations, partitions, block, False)


def repaired_turns(conversations: DataFrame, partitions: int | None = None, block: int = BLOCK) -> DataFrame:
    """The repaired conversations: conv_id, seq from 0, role, text."""
    return _conversations(conversations, partitions, block, True)


def judged(conversations: DataFrame, **options: int) -> DataFrame:
    """The result of the registered query: ``repairs`` of the damaged rows."""
    return repairs(damaged(conversations), **options)


#: DuckDB: the same as a dynamic program turn by turn; CRC-32 is folded bit by bit.
ORACLE = """
WITH RECURSIVE crcs AS (
  SELECT k, list_reduce(list_concat([4294967295], flatten([[ord(substr(k, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, length(k) + 1)])),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT DISTINCT coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations)
), lots AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(c, 4294967295) % 20 AS lot
  FROM conversations JOIN crcs ON k = coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')
), damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM lots, unnest(CASE WHEN lot = 3 THEN [0, 1] WHEN lot = 0 THEN []::int[] ELSE [0] END)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged
), faults AS (
  SELECT *, left(role, 1) AS c, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b
  FROM numbered
), steps AS (
  SELECT conv_id, i, c, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM faults
), ways AS (
  SELECT DISTINCT conv_id, 0::bigint AS i, {'n': 0, 'a': ''} AS s0, {'n': 1000000000, 'a': ''} AS s1, {'n': 2, 'a': 'I'} AS s2, {'n': 4, 'a': 'II'} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, i, s0, s1, u, least(v, {'n': u.n + 2, 'a': u.a || 'I'}) FROM (
    SELECT conv_id, i, d0 AS s0, d1 AS s1, v, least(d2, {'n': d0.n + 2, 'a': d0.a || 'I'}, {'n': d1.n + 2, 'a': d1.a || 'I'}, {'n': v.n + 2, 'a': v.a || 'I'}) AS u FROM (
      SELECT w.conv_id, s.i, {'n': s0.n + 3, 'a': s0.a || 'D'} AS d0,
        least({'n': s1.n + 3, 'a': s1.a || 'D'}, {'n': s0.n + t + CASE WHEN must OR c <> 's' THEN 1000000000 ELSE 0 END, 'a': s0.a || 'K'}) AS d1,
        least({'n': s2.n + 3, 'a': s2.a || 'D'},
          {'n': s0.n + t + CASE WHEN must THEN 1000000000 WHEN c = 'u' THEN 0 ELSE 2 END, 'a': s0.a || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END},
          {'n': s1.n + t + CASE WHEN must THEN 1000000000 WHEN c = 'u' THEN 0 ELSE 2 END, 'a': s1.a || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END},
          {'n': s3.n + t + CASE WHEN must THEN 1000000000 WHEN c = 'u' THEN 0 ELSE 2 END, 'a': s3.a || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END}) AS d2,
        least({'n': s3.n + 3, 'a': s3.a || 'D'},
          {'n': s2.n + t + CASE WHEN must THEN 1000000000 WHEN c = 'a' THEN 0 ELSE 2 END, 'a': s2.a || CASE WHEN c = 'a' THEN 'K' ELSE 'R' END}) AS v
      FROM ways w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1)))
, ends AS (
  SELECT conv_id, arg_max(least(s0, s3), i) AS best FROM ways GROUP BY conv_id
), edits AS (
  SELECT conv_id, p, substr(best.a, p::int, 1) AS e, count(*) FILTER (substr(best.a, p::int, 1) <> 'I') OVER w AS i, count(*) FILTER (substr(best.a, p::int, 1) <> 'D') OVER w AS o
  FROM ends, unnest(range(1, length(best.a) + 1)) AS x(p) WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), lines AS (
  SELECT e.conv_id, e.p, e.o, e.e, f.role, f.text,
    max(CASE WHEN e.e = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
  FROM edits e LEFT JOIN faults f ON e.e <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.e <> 'D'
), hashes AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h
  FROM lines GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (b IS NOT NULL AND b || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
  coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, best.n::bigint AS cost, best.a AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM e.conv_id
"""
