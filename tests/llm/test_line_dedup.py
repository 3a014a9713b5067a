from __future__ import annotations

import random
from collections import defaultdict

import xxhash
from llm.texts import corpus

from tallystone.llm import line_dedup as q


def brute(rows):
    places = defaultdict(list)
    for at, (i, text) in enumerate(rows):
        whole = (text or "").encode()
        for a, b, n in q.chunks(whole):
            chunk = whole[a:b].removesuffix(b"\n")
            if n > 1 and chunk.strip():
                places[chunk].append((i, at, a))
    out = {}
    for at, (i, text) in enumerate(rows):
        if text is None:
            out[at] = (None, 0)
            continue
        whole, kept, gone = text.encode(), [], 0
        for a, b, n in q.chunks(whole):
            chunk = whole[a:b].removesuffix(b"\n")
            found = places.get(chunk, []) if n > 1 else []
            if len(found) > 1 and min(found) != (i, at, a):
                gone += 1
            else:
                kept.append(whole[a:b])
        left = b"".join(kept)
        if gone and kept and not whole.endswith(b"\n"):
            left = left.removesuffix(b"\n")
        out[at] = (left.decode(), gone)
    return out


def test_equals_brute_force(spark, documents):
    rows = list(enumerate(corpus(2, 40)))
    want = brute(rows)
    got = {r.doc_id: (r.text, r.n_chunks_removed) for r in q.judged(documents([t for _, t in rows])).collect()}
    assert got == want
    assert sum(n for _, n in got.values()) > 5


def test_borders_follow_content():
    body = "\n".join(f"line number {i * i % 97} of it" for i in range(60)).encode()
    whole, moved = q.chunks(body), q.chunks(b"one more line\n" + body)
    inside = {body[a:b] for a, b, _ in whole[2:-1]}
    assert inside <= {(b"one more line\n" + body)[a:b] for a, b, _ in moved}
    assert all(n > 1 for _, _, n in whole[1:-1])
    assert b"".join(body[a:b] for a, b, _ in whole) == body


def test_equal_hashes_of_different_bytes(spark, documents, monkeypatch):
    texts = corpus(2, 12)
    one, by_text = q.repeated_chunks(documents(texts).selectExpr("doc_id AS id", "xxhash64(text) AS t", "text"))
    assert one.where("shared").count() == 0 and by_text.count() == one.count() > 0
    assert q._without("a b\nc d", [{"h": q._hash(b"a b\nc d"), "mine": False, "bytes": None}])[2] == 1
    import zstandard

    other = zstandard.ZstdCompressor(level=1).compress(b"e f\ng h")
    assert q._without("a b\nc d", [{"h": q._hash(b"a b\nc d"), "mine": False, "bytes": other}])[2] == 0


def test_replaced_texts_keep_columns(spark, documents):
    docs = documents(corpus(2, 10))
    out = q.with_texts_replaced(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("n_chars != length(text)").count() == 0
    assert q.with_texts_replaced(docs.limit(0)).count() == 0


def slow_borders(lines):
    """Borders of lines without equal neighbours, from the rule itself."""
    h = [xxhash.xxh64_intdigest(line.encode()) for line in lines]
    base, rolled = 0x9E3779B97F4A7C15, {}
    for i in range(1, len(h) - 1):
        value = (h[i] * base + h[i + 1]) % 2**64
        rolled[i] = value ^ value >> 29
    return [i for i, r in rolled.items() if all(r < rolled[j] for j in (i - 1, i + 1) if j in rolled)]


def test_borders_equal_the_rule():
    rng = random.Random(7)
    for n in [*range(1, 12), 400]:
        lines = [f"line {rng.random()}" for _ in range(n)]
        text = "\n".join(lines)
        starts = [len("\n".join([*lines[:i], ""])) for i in slow_borders(lines)]
        assert [a for a, _, _ in q.chunks(text.encode())] == [0, *starts]


def test_a_border_depends_on_four_lines():
    rng = random.Random(5)
    for _ in range(40):
        body = [f"line {rng.random()}" for _ in range(4)]
        found = set()
        for _ in range(12):
            text = "\n".join([*(f"{rng.random()}" for _ in range(3)), *body, *(f"{rng.random()}" for _ in range(3))])
            found.add(text.index(body[1]) in {start for start, _, _ in q.chunks(text.encode())})
        assert len(found) == 1


def test_rows_that_repeat_an_id(spark, documents):
    passage = "\n".join(f"shared line {i * i}" for i in range(12))
    one, other = f"head\n{passage}\ntail", f"first\n{passage}\nlast"
    again = documents([one, other, one]).selectExpr("1L AS doc_id", "text")
    rows = [(r.text, r.n_chunks_removed > 0) for r in q.judged(again).collect()]
    whole = [text for text, removed in rows if not removed]
    # one of the two texts stays whole, in each of its rows; the other one loses the passage
    assert len(rows) == 3 and set(whole) in ({one}, {other}) and len(whole) == (2 if one in whole else 1)
    ids = sorted((r.doc_id or 99, r.n_chunks_removed > 0) for r in q.judged(documents([(None, one), (-7, other), (4, one)])).collect())
    assert ids == [(-7, False), (4, True), (99, True)]


def test_runs_of_equal_lines_are_cut():
    def cut(*lines):
        return [n for _, _, n in q.chunks("\n".join(lines).encode())]

    assert cut(*["x"] * 9) == [2, 2, 2, 3]
    assert cut("a", "b", *["x"] * 4, "c", "c", "d") == [2, 2, 2, 2, 1]
    assert cut("x", "x", "b", "c", "c") == [2, 3]
    rng = random.Random(6)
    for _ in range(300):
        sizes = cut(*rng.choices("abc", k=rng.randint(1, 14)))
        assert all(n > 1 for n in sizes[1:-1])


def test_runs_of_other_lengths_are_repeated(spark, documents):
    texts = ["\n".join([f"head {i}", f"next {i}", *["same line"] * n, f"then {i}", f"last {i}"]) for i, n in enumerate((8, 6, 11))]
    left = [r.text.split("\n").count("same line") for r in q.judged(documents(texts)).orderBy("doc_id").collect()]
    assert left == [2, 0, 3]
