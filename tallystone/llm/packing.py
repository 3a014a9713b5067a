"""Variable-capacity best-fit packing of documents into sequences.

Several sequence lengths are permitted at once. Per block of pieces, longest first, a piece goes to
the open bin that it leaves least room in; where none has room, the bin size is opened that costs
least per word it can be expected to hold, given the pieces still to come; at the end every bin is
downsized to the smallest permitted length that holds its contents. A bin costs a
fixed part, its length, and a part that grows with its square, as attention does.

A block is a fixed number of successive pieces of one partition, so nothing is shuffled, no task
holds more than a block, and hot sources or ids make no difference. Blocks are packed on their
own: at most a few bins per block are less full than they could be.

Texts longer than the largest length are cut, after a word, into pieces of that length. The bytes
of the pieces in order are the text. Cases: a text of no words (null, empty, blank) is one
piece of length 0 that takes no room and stands in a bin of the smallest length or as a guest of
another bin; null texts give null pieces. Repeated rows are packed one by one. Other columns are
not returned.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallystone.llm.common import WORD, small_batches

LENGTHS = (256, 512, 1024, 2048)
BLOCK_WORDS = 1 << 20  # words in a block, or BLOCK_PIECES pieces
BLOCK_PIECES = 1 << 15
FIXED = 64.0  # words' worth of cost of any bin
SQUARE = 0.25  # the square part of the cost of the largest length, in parts of its length

SCHEMA = "bin string, capacity bigint, used bigint, slot bigint, offset bigint, doc_id bigint, piece bigint, n_words bigint, text string"


def cost(length: int, lengths: Sequence[int] = LENGTHS) -> float:
    return FIXED + length + SQUARE * length * length / max(lengths)


def pieces(text: str | None, longest: int) -> list[tuple[int, str | None]]:
    """(words, text) of the pieces of a text; a cut stands before the first word of the next piece."""
    if text is None:
        return [(0, None)]
    whole = text.encode()
    starts = [m.start() for m in WORD.finditer(whole)]
    if len(starts) <= longest:
        return [(len(starts), text)]
    cuts = [0, *starts[longest::longest], len(whole)]
    counts = [min(longest, len(starts) - k * longest) for k in range(len(cuts) - 1)]
    return [(n, whole[a:b].decode()) for n, a, b in zip(counts, cuts, cuts[1:])]


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int]]:
    """(bin of each piece, capacity of each bin) for pieces no longer than the longest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left = sum(sizes)  # words not packed yet
    room: list[tuple[int, int]] = []  # (room, bin) of bins that are not full
    place, used, opened = [0] * len(sizes), [], []
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            # what a new bin may hold: all of it, or what is left to pack
            b = len(used)
            fitting = [c for c in lengths if c >= size]
            capacity = min(fitting, key=lambda c: (cost(c, lengths) / max(min(c, left), 1), c))
            used.append(0)
            opened.append(capacity)
            free = capacity
        place[i] = b
        used[b] += size
        left -= size
        if free > size or not size:
            insort(room, (free - size, b))
    return place, [lengths[bisect_left(lengths, u)] for u in used]


def _packed(block: list[tuple], name: str, lengths: Sequence[int]) -> pd.DataFrame:
    place, capacity = best_fit([b[2] for b in block], lengths)
    used, slots = [0] * len(capacity), [0] * len(capacity)
    for b, piece in zip(place, block):
        used[b] += piece[2]
    offsets, rows = [0] * len(capacity), []
    for b, (doc_id, number, n, text) in zip(place, block):
        rows.append((f"{name}-{b}", capacity[b], used[b], slots[b], offsets[b], doc_id, number, n, text))
        slots[b] += 1
        offsets[b] += n
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})


def packed(docs: DataFrame, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """One row per piece: its bin, the bin's capacity and words used, the piece's slot and offset in
    the bin, and the document, number, words and text of the piece."""
    small_batches(docs.sparkSession)
    lengths = tuple(sorted(lengths))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, block, words = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                for k, (n, piece) in enumerate(pieces(text, lengths[-1])):
                    block.append((doc_id, k, n, piece))
                    words += n
                    if words >= BLOCK_WORDS or len(block) >= BLOCK_PIECES:
                        yield _packed(block, f"{part}-{number}", lengths)
                        number, block, words = number + 1, [], 0
        if block:
            yield _packed(block, f"{part}-{number}", lengths)

    return docs.select("doc_id", "text").mapInPandas(pack, SCHEMA)
