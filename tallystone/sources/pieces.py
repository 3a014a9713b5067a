"""Statement files of any size: one file is read in pieces by many tasks.

Spark's text source cuts a file at byte ranges and hands out records that end with ``>``, so every piece is a
run of whole tags. What a piece needs from those before it is small: the tags that are open where it starts, and how many statements,
sections and rows there were. Both are carried by folds over one summary row per piece:

1. each piece tells how many tags it closes that others opened, and which of its own it leaves open;
2. with the open tags put before it, each piece is parsed on its own, its ordinals counted from the piece's start;
3. ordinals of earlier pieces are added, and a fault in one piece is a fault of the whole payload.

The result has the columns of ``statements.parse_payloads``, and the same rows.

Cases: a file with a ``>`` inside a quoted value, comment, CDATA section or document type can't be cut by tags; its
records are brought back in order and parsed by one task, in a stream. An empty file is an empty payload. Files are UTF-8
(the default of XML); one that declares another encoding is reported, and can be read by ``statements.read_payloads``.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.session import stored
# by name: a module that is referred to as a whole would be looked for on the workers
from tallystone.sources.statements import EMPTY_PAYLOAD, MALFORMED_PAYLOAD, NAMESPACE, NO_STATEMENT, STATEMENT, STATEMENTS, _maps, _qualified

OTHER_ENCODING = "the payload declares another encoding than UTF-8"

PIECE = "payload_id string, piece bigint"
SUMMARY = f"{PIECE}, bytes bigint, file_bytes bigint, simple boolean, encoded boolean, closes bigint, child boolean, opens array<binary>, parents array<boolean>"
START = f"{PIECE}, stack array<binary>, parents array<boolean>, first boolean, last boolean, cut boolean, fault string"
LOCAL = (
    f"{PIECE}, kind string, lead int, statement_index int, section_index int, section_name string, row_tag string, row_index int, "
    "payload map<string,string>, error string, declared_count string, containers int, statements int, sections int, rows int, found int"
)
OFFSET = f"{PIECE}, s int, c int, r int, fault string, declared string, n_found int"

_VALUE = rb"""[^<"']*(?:(?:"[^"<]*"|'[^'<]*')[^<"']*)*"""  # plain runs at once, not letter by letter
#: One record without its ``>``: text, then at most one tag, instruction or comment that ends here.
_RECORD = re.compile(rb"(?s)[^<]*(?:<(?:(?P<close>/)[^<]*|\?[^<]*\?|!--(?:(?!--)[^<])*--|!DOCTYPE[^<\[]*|(?P<open>[^/!?<]" + _VALUE + rb")))?")
_ENCODING = re.compile(rb"""<\?xml\s[^<]*encoding\s*=\s*["']([^"']*)["']""")
_UTF8 = (b"utf-8", b"utf8", b"us-ascii", b"ascii")
_BATCH_ROWS = 4096
#: Pieces whose starts are broadcast; the starts of more meet their records in a shuffle.
MAX_BROADCAST = 50_000

# The parser travels with the job, as that of whole payloads does.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def _piece_size(spark: SparkSession, size: int | None) -> Iterator[None]:
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if size:
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def records(spark: SparkSession, path: str) -> DataFrame:
    """payload_id, piece (its first byte), file_bytes and the records of the files, in order within a piece."""
    text = spark.read.option("lineSep", ">").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("payload_id"),
        F.col("_metadata.file_block_start").alias("piece"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.col("value").cast("binary").alias("record"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[bytes], dict]]:
    """Records of one piece after another, in lots: (key, records, first row of the lot)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # facts are made for the first row of a lot only: they are the same for all of its records
        piece, file = batch.column("piece").to_numpy(), batch.column("payload_id").dictionary_encode().indices.to_numpy()
        ends = [*(((piece[1:] != piece[:-1]) | (file[1:] != file[:-1])).nonzero()[0] + 1).tolist(), batch.num_rows]
        records, at = batch.column("record").to_pylist(), 0
        for end in ends:
            first = {name: batch.column(name)[at].as_py() for name in batch.schema.names if name != "record"}
            yield (first["payload_id"], first["piece"]), records[at:end], first
            at = end


class _Summary:
    """What a piece closes and leaves open, whatever stands before it."""

    def __init__(self, first: dict):
        self.file_bytes, self.bytes, self.closes = first["file_bytes"], 0, 0
        self.simple, self.encoded, self.child = True, False, False
        self.opens: list[bytes] = []
        self.parents: list[bool] = []

    def add(self, records: list[bytes]) -> None:
        for record in records:
            self.bytes += len(record) + 1
            found = _RECORD.fullmatch(record)
            if found is None:
                self.simple = False
                continue
            if b"<?xml" in record and (name := _ENCODING.search(record)):
                self.encoded |= name[1].lower() not in _UTF8
            if found["close"]:
                if self.opens:
                    self.opens.pop()
                    self.parents.pop()
                else:
                    self.closes += 1
            elif found["open"]:
                if self.parents:
                    self.parents[-1] = True
                else:
                    self.child = True
                if not record.endswith(b"/"):
                    self.opens.append(record[record.index(b"<") :] + b">")
                    self.parents.append(False)

    def row(self, key: tuple) -> tuple:
        return *key, self.bytes, self.file_bytes, self.simple, self.encoded, self.closes, self.child, self.opens, self.parents


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("payload_id", pa.string()), ("piece", pa.int64()), ("bytes", pa.int64()), ("file_bytes", pa.int64()), ("simple", pa.bool_()), ("encoded", pa.bool_())]
        + [("closes", pa.int64()), ("child", pa.bool_()), ("opens", pa.list_(pa.binary())), ("parents", pa.list_(pa.bool_()))]
    )
    key = summary = None
    rows = []
    for at, lot, first in _runs(batches):
        if at != key:
            if summary:
                rows.append(summary.row(key))
            key, summary = at, _Summary(first)
        summary.add(lot)
    if summary:
        rows.append(summary.row(key))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _starts(pieces: pd.DataFrame) -> pd.DataFrame:
    """Open tags at the start of each piece of one file."""
    pieces = pieces.sort_values("piece")
    stack: list[bytes] = []
    parents: list[bool] = []
    fault = OTHER_ENCODING if pieces["encoded"].any() else None
    whole = not pieces["simple"].all()
    cut = int(pieces["bytes"].sum()) > int(pieces["file_bytes"].iloc[0])  # the last record has no ``>``
    rows = []
    for i, p in enumerate(pieces.itertuples(index=False)):
        rows.append([p.payload_id, p.piece, list(stack), list(parents), i == 0, i == len(pieces) - 1, cut, None])
        if whole:
            continue
        if p.closes > len(stack):
            fault = fault or MALFORMED_PAYLOAD
            break
        if p.closes:
            del stack[-p.closes :], parents[-p.closes :]
        if parents and (p.closes or p.child):
            parents[-1] = True
        stack += list(p.opens)
        parents += [bool(x) for x in p.parents]
    if whole:  # one piece, parsed in order
        rows = [[*rows[0][:2], [], [], True, True, cut, None]]
    for row in rows:
        row[-1] = fault
    return pd.DataFrame(rows, columns=[c.split()[0] for c in START.split(", ")])


class _Walk:
    """One piece: rows with ordinals counted from its start.

    ``lead`` tells which ordinals are whole: 0 none (the row belongs to a section of an earlier piece), 1 those within
    the section, 2 those within the statement."""

    def __init__(self, key: tuple, start: dict):
        self.key, self.rows = key, []
        self.names: list[str] = []
        self.attributes: list[dict] = []
        self.has_child: list[bool] = []
        self.statement = self.section = -1
        self.row = self.base = self.lead = 0
        self.statements = self.containers = self.found = 0
        self.declared = self.error = None
        self.finished, self.last, self.cut = False, start["last"], start["cut"]
        self.after = not start["first"] and not start["stack"]  # the root is closed: no more elements
        self.parser = expat.ParserCreate("UTF-8", NAMESPACE)
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._replay, self._end
        self._feed(b"<r></r>" if self.after else b"".join(start["stack"]))
        if self.after:
            self.names, self.attributes, self.has_child = [], [], []
        else:
            self.has_child = [bool(p) for p in start["parents"]]
        self.parser.StartElementHandler = self._start
        self.held: bytes | None = None

    def _feed(self, data: bytes, final: bool = False) -> None:
        if self.error is None:
            try:
                self.parser.Parse(data, final)
            except (expat.ExpatError, ValueError):
                self.error = MALFORMED_PAYLOAD

    def add(self, records: list[bytes]) -> None:
        lot = records if self.held is None else [self.held, *records]
        self.held = lot[-1]
        if len(lot) > 1:
            self._feed(b">".join(lot[:-1]) + b">")

    def end(self) -> None:
        open_end = self.last and self.cut
        self._feed(self.held if open_end else self.held + b">", self.last)

    def _named(self, name: str, own: dict) -> tuple[str, dict]:
        if NAMESPACE in name or any(NAMESPACE in key for key in own):
            return _qualified(name), {_qualified(key): value for key, value in own.items()}
        return name, own

    def _push(self, name: str, own: dict) -> None:
        if self.has_child:
            self.has_child[-1] = True
        self.names.append(name)
        self.attributes.append(own)
        self.has_child.append(False)

    def _replay(self, name: str, own: dict) -> None:
        name, own = self._named(name, own)
        if name == STATEMENT and not self.base:
            self.base = len(self.names) + 1
        self._push(name, own)

    def _emit(self, kind: str, section: int | None, name: str | None, tag: str | None, row: int | None, own: dict) -> None:
        self.rows.append((*self.key, kind, self.lead, self.statement, section, name, tag, row, own, *[None] * 7))

    def _start(self, name: str, own: dict) -> None:
        name, own = self._named(name, own)
        if name == STATEMENTS:
            self.containers += 1
            self.declared = own.get("count") if self.containers == 1 else self.declared
        elif name == STATEMENT:
            self.found += 1
        if name == STATEMENT and not self.base:
            self.statement, self.section, self.base = self.statement + 1, -1, len(self.names) + 1
            self.row, self.lead = 0, 2
            self.statements += 1
            self._emit("statement", None, None, None, None, own)
        elif self.base and len(self.names) == self.base:
            self.section, self.row, self.lead = self.section + 1, 0, max(self.lead, 1)
        self._push(name, own)

    def _end(self, _: str) -> None:
        leaf = not self.has_child.pop()
        name, own = self.names.pop(), self.attributes.pop()
        depth, base = len(self.names), self.base
        if base and leaf and depth == base:
            self._emit("empty", self.section, name.strip(), None, None, own)
        elif base and leaf and depth > base:
            self.row += 1
            merged: dict = {}
            for outer in self.attributes[base:]:
                merged.update(outer)
            merged.update(own)
            self._emit("row", self.section, self.names[base].strip(), name, self.row, merged)
        elif base and depth == base - 1:
            self.base = 0

    def total(self) -> tuple:
        counts = (self.declared, self.containers, self.statements, self.section + 1, self.row, self.found)
        return *self.key, "piece", self.lead, None, None, None, None, None, None, self.error, *counts


_LOCAL_ARROW = pa.schema(
    [("payload_id", pa.string()), ("piece", pa.int64()), ("kind", pa.string()), ("lead", pa.int32()), ("statement_index", pa.int32())]
    + [("section_index", pa.int32()), ("section_name", pa.string()), ("row_tag", pa.string()), ("row_index", pa.int32())]
    + [("payload", pa.map_(pa.string(), pa.string())), ("error", pa.string()), ("declared_count", pa.string())]
    + [(name, pa.int32()) for name in ("containers", "statements", "sections", "rows", "found")]
)


def _local_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [_maps(c) if pa.types.is_map(f.type) else pa.array(c, f.type) for c, f in zip(zip(*rows), _LOCAL_ARROW)]
    return pa.RecordBatch.from_arrays(columns, schema=_LOCAL_ARROW)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of every piece as they are read, then its counts."""
    walk = None
    for key, lot, first in _runs(batches):
        if walk is None or key != walk.key:
            if walk:
                walk.end()
                yield _local_batch([*walk.rows, walk.total()])
            walk = _Walk(key, first)
        walk.add(lot)
        if len(walk.rows) >= _BATCH_ROWS:
            yield _local_batch(walk.rows)
            walk.rows = []
    if walk:
        walk.end()
        yield _local_batch([*walk.rows, walk.total()])


def _offsets(pieces: pd.DataFrame) -> pd.DataFrame:
    """What each piece of one file adds to its ordinals, and the facts of the whole payload."""
    pieces = pieces.sort_values("piece")
    s = c = r = containers = found = 0
    declared, fault, rows = None, None, []
    for p in pieces.itertuples(index=False):
        rows.append([p.payload_id, p.piece, s, c, r])
        s += p.statements
        c = p.sections if p.lead == 2 else c + p.sections
        r = p.rows if p.lead else r + p.rows
        if not containers and p.containers:
            declared = p.declared_count
        containers += p.containers
        found += p.found
        fault = fault or p.error
    if fault:
        declared, found = None, 0
    elif not found:
        fault = NO_STATEMENT
    return pd.DataFrame([[*row, fault, declared, found] for row in rows], columns=[x.split()[0] for x in OFFSET.split(", ")])


def _in_order(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Records with their starts joined by ``keys``; those of equal keys in one task and in order."""
    numbered = T.StructType([*rows.schema, T.StructField("place", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            yield batch.append_column("place", pa.array(range(place, place + batch.num_rows), pa.int64()))
            place += batch.num_rows

    starts = starts.withColumn("at", F.col("piece"))
    placed = rows.mapInArrow(number, numbered).join(starts.drop(*({"payload_id", "piece"} - set(keys))), keys)
    ordered = placed.repartition(*keys).sortWithinPartitions("payload_id", "piece", "place")
    return ordered.withColumn("piece", F.col("at")).drop("at", "place")


def parse_files(spark: SparkSession, path: str, piece_bytes: int | None = None) -> DataFrame:
    """The files below ``path`` as ``statements.parse_payloads`` would give them, each read by as many tasks as it
    has pieces of ``piece_bytes`` (the session's split size if not given)."""
    with _piece_size(spark, piece_bytes):
        summaries = records(spark, path).mapInArrow(_summaries, SUMMARY)
        summaries = stored(summaries, "summaries")
        starts = stored(summaries.groupBy("payload_id").applyInPandas(_starts, START), "starts")
        whole = summaries.groupBy("payload_id").agg(F.bool_and("simple").alias("simple"))
        tags = starts.where(F.col("fault").isNull()).select("payload_id", "piece", "stack", "parents", "first", "last", "cut")
        kind = tags.join(whole, "payload_id")
        facts = ("payload_id", "piece", "stack", "parents", "first", "last", "cut")
        regular, irregular = (kind.where(c).select(*facts) for c in ("simple", "NOT simple"))
        keys = ["payload_id", "piece"]
        if starts.count() <= MAX_BROADCAST:  # a broadcast leaves the records in their order
            local = records(spark, path).join(F.broadcast(regular), keys)
        else:
            local = _in_order(records(spark, path), regular, keys)
        local = local.mapInArrow(_walked, LOCAL)
        if not irregular.isEmpty():
            local = local.unionByName(_in_order(records(spark, path), irregular, keys[:1]).mapInArrow(_walked, LOCAL))
        local = stored(local, "pieces")
    offsets = local.where("kind = 'piece'").groupBy("payload_id").applyInPandas(_offsets, OFFSET)
    offsets = stored(offsets, "offsets")
    rows = local.where("kind != 'piece'").join(offsets.where("fault IS NULL"), ["payload_id", "piece"])
    good = rows.select(
        "payload_id",
        "kind",
        (F.col("statement_index") + F.col("s")).alias("statement_index"),
        (F.col("section_index") + F.when(F.col("lead") < 2, F.col("c")).otherwise(0)).alias("section_index"),
        "section_name",
        "row_tag",
        (F.col("row_index") + F.when(F.col("lead") < 1, F.col("r")).otherwise(0)).alias("row_index"),
        "payload",
        F.lit(None).cast("string").alias("error"),
        F.col("declared").alias("declared_count"),
        F.col("n_found").alias("statement_count"),
    )
    known = starts.where("fault IS NOT NULL").select("payload_id", "fault").unionByName(offsets.where("fault IS NOT NULL").select("payload_id", "fault"))
    files = spark.read.format("binaryFile").load(path).where("length = 0").select(F.col("path").alias("payload_id"), F.lit(EMPTY_PAYLOAD).alias("fault"))
    faults = known.unionByName(files).groupBy("payload_id").agg(F.min("fault").alias("error"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema}
    empty |= {"payload_id": F.col("payload_id"), "kind": F.lit("error").alias("kind"), "error": F.col("error"), "statement_count": F.lit(0).alias("statement_count")}
    return good.unionByName(faults.select(*empty.values()))
