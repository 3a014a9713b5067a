from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm.texts import corpus

from tallystone.llm import suffix_dedup, window_dedup
from tallystone.llm.common import merged


def brute(units, window):
    seen = Counter(u[i : i + window] for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        spans = merged((i, i + window) for i in range(len(u) - window + 1) if seen[u[i : i + window]] > 1)
        cut = {j for a, b in spans for j in range(a, b)}
        out.append((len(u), len(cut), len(spans), [x for j, x in enumerate(u) if j not in cut]))
    return out


def texts():
    rng = random.Random(3)
    found = corpus(5, 30)
    long_ = found[-1].split(" ")
    for n in (20, 36, 60, 90, 200):  # pieces of a text elsewhere, between other words
        at = rng.randrange(len(long_) - n)
        found.append(" ".join([*long_[:7], "else", *long_[at : at + n], "other"]))
    return [*found, "ab" * 900, "ab" * 450 + "c" + "ab" * 450, "é" * 700]


@pytest.mark.parametrize("hot", [4096, 3])
def test_byte_windows(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PART", 40)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 2)
    monkeypatch.setattr(suffix_dedup, "TILE", 900)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 5000)
    rows = texts()
    for window, base in ((400, 64), (60, 16)):
        want = brute([(t or "").encode() for t in rows], window)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.judged(documents(rows), window, base).collect()}
        assert got == {i: (n, cut, spans, hashlib.sha256(bytes(kept)).hexdigest()) for i, (n, cut, spans, kept) in enumerate(want)}
        assert sum(cut > 0 for _, cut, _, _ in want) > 6


@pytest.mark.parametrize("hot", [4096, 3])
def test_word_windows(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(window_dedup, "HOT", hot)
    monkeypatch.setattr(window_dedup, "GATHERED", 30)
    monkeypatch.setattr(window_dedup, "TILE", 200)
    rows = texts()
    want = brute([tuple((t or "").encode().split()) for t in rows], 35)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in window_dedup.judged(documents(rows)).collect()}
    assert got == {i: (n, cut, hashlib.sha256(b" ".join(kept)).hexdigest()) for i, (n, cut, _, kept) in enumerate(want)}


def test_null_and_repeated_ids(spark, documents):
    same = " ".join(f"w{i}" for i in range(200))
    rows = [(None, same), (None, same), (5, same + " x"), (5, same + " x"), (0, None), (0, "")]
    got = sorted((r.n_words, r.n_removed) for r in window_dedup.judged(documents(rows)).collect())
    assert got == [(0, 0), (0, 0), (200, 200), (200, 200), (201, 201), (201, 201)]
    got = sorted((r.n_removed, r.n_spans) for r in suffix_dedup.judged(documents(rows)).collect())
    assert got == [(0, 0), (0, 0), (len(same), 1), (len(same), 1), (len(same) + 2, 1), (len(same) + 2, 1)]
    for q in (suffix_dedup, window_dedup):
        assert q.judged(documents(rows).limit(0)).collect() == []


def test_levels_double():
    assert window_dedup.levels(35) == [9, 18, 35]
    assert all(b <= 2 * a for a, b in zip(window_dedup.levels(100), window_dedup.levels(100)[1:]))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 100, 3000, dtype=np.uint8).tobytes()
    one = suffix_dedup.anchors(body, 200, 32)
    two = suffix_dedup.anchors(b"zz" + body[:2500], 200, 32)
    at = lambda found, i: found[0][np.searchsorted(found[1], i, side="right") - 1]
    assert all(at(two, i + 2) == at(one, i) + 2 for i in range(2300))
    assert (one[2] - one[1]).sum() + len(one[0]) == 2801


def test_loser_tree_merges_runs_and_shares():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 12))).encode() for _ in range(300)]
    for k in (1, 2, 3, 7, 16):
        runs = []
        for r in range(k):
            run = sorted(words[r::k])
            runs.append(iter([(suffix_dedup.shared(a, b, 0), (b, b"", 0, 0, 0, 0)) for a, b in zip([b"", *run], run)]))
        out = list(suffix_dedup.merge(runs))
        assert [s[0] for _, s in out] == sorted(words)
        assert [h for h, _ in out[1:]] == [suffix_dedup.shared(a, b, 0) for a, b in zip(sorted(words), sorted(words)[1:])]
    assert list(suffix_dedup.merge([iter(())])) == []


def test_front_coding_round_trip():
    rng = random.Random(7)
    run = [(bytes(rng.choices(b"ab", k=90)), b"left", i, -i, i + 1, 2) for i in range(200)]
    run[:] = sorted(run)
    splitters = sorted({run[60][0][:64], run[140][0][:64]})
    pieces = list(suffix_dedup.coded(list(run), splitters, 64))
    assert [p[0] for p in pieces] == [0, 1, 2]
    assert [s for p in pieces for _, s in suffix_dedup.decoded(*p[1:])] == run
