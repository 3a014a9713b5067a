from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from llm.texts import corpus

from tallystone.llm import packing, sharding


def test_pieces_are_the_texts_and_bins_hold_them(spark, documents):
    texts = corpus(8, 20)
    rows = packing.packed(documents(texts), (16, 64, 128)).collect()
    found, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.piece, r.text))
        bins[r.bin].append(r)
    assert {i: None if x[0][1] is None else "".join(t for _, t in sorted(x)) for i, x in found.items()} == dict(enumerate(texts))
    for held in bins.values():
        used = sum(r.n_words for r in held)
        assert {(r.used, r.capacity) for r in held} == {(used, next(c for c in (16, 64, 128) if c >= used))}
        at = 0
        for r in sorted(held, key=lambda r: r.slot):
            assert (r.offset, len((r.text or "").encode().split())) == (at, r.n_words)
            at += r.n_words
        assert sorted(r.slot for r in held) == list(range(len(held)))
    assert packing.packed(documents(texts).limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=80))
def test_best_fit(sizes):
    place, capacity = packing.best_fit(sizes, (8, 32, 64))
    used = Counter()
    for b, n in zip(place, sizes):
        used[b] += n
    assert len(place) == len(sizes) and set(place) == set(range(len(capacity)))
    assert all(capacity[b] == next(c for c in (8, 32, 64) if c >= used[b]) for b in range(len(capacity)))
    assert sum(1 for b in range(len(capacity)) if used[b] <= 4) <= 1 or not sum(sizes)


def test_full_bins_cost_less_than_one_length(spark):
    sizes = [i * 37 % 500 + 1 for i in range(3000)]
    _, capacity = packing.best_fit(sizes)
    assert sum(sizes) / sum(capacity) > 0.97
    fixed = packing.best_fit(sizes, (2048,))[1]
    assert sum(map(packing.cost, capacity)) < sum(map(packing.cost, fixed))


def test_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 3)
    rows = packing.packed(documents(corpus(8, 9))).collect()
    assert len({r.bin for r in rows}) > 3 and len({(r.bin, r.slot) for r in rows}) == len(rows)


def test_shards_match_the_mixture(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 20)
    texts = corpus(4, 150)
    rows = sharding.sharded(documents(texts)).collect()
    shards, mixture = defaultdict(list), defaultdict(Counter)
    for r in rows:
        shards[r.shard].append(r.slot)
        mixture[r.source][r.shard] += 1
        whole = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(whole) + 1, zlib.crc32(whole), "rows", None)
    sizes = [len(shards[s]) for s in range(16)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(max(c[s] for s in range(16)) - min(c[s] for s in range(16)) <= 2 for c in mixture.values())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(documents(texts).repartition(7)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_few_and_repeated_rows(spark, documents):
    rows = sharding.sharded(documents([(None, "a"), (None, "a"), (1, None)])).collect()
    assert sorted(r.slot for r in rows) == [0, 0, 0] and len({r.shard for r in rows}) == 3
    assert sharding.sharded(documents(["a"]).limit(0)).collect() == []
