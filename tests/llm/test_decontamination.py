from __future__ import annotations

import hashlib
import re

import pytest
from llm.texts import corpus, sentence

from tallystone.llm import decontamination as q


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = {}
    for i, text in enumerate(texts):
        w, hit, found = words_of(text), set(), set()
        for window, ids in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= ids
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [100_000, 7])
def test_equals_brute_force(spark, documents, monkeypatch, block):
    import random

    monkeypatch.setattr(q, "BLOCK", block)
    rng = random.Random(2)
    texts = corpus(6, 12)
    passages = [sentence(rng, n) for n in (14, 10, 30, 10)]
    texts += [f"Before, {passages[0].upper()}! after", f"{passages[1]} {passages[1]}", f"x-{passages[2][:60]}", "rare pair", "rare, Pair lone", passages[3]]
    items = [(1, passages[0]), (10, passages[1]), (2, passages[2]), (3, "rare pair"), (4, "LONE"), (5, None), (6, " ?"), (None, passages[3]), (1, passages[0])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in q.judged(documents(texts), benchmark).collect()}
    want = brute(texts, items)
    assert got == want and sum(w[4] for w in want.values()) >= 5
    clean = q.without_contaminated(documents(texts), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}
    assert clean.columns == documents(texts).columns


def test_a_window_of_many_items(spark, documents):
    import random

    rng = random.Random(9)
    prompt = sentence(rng, 12)
    texts = [f"{sentence(rng, 5)} {prompt} {sentence(rng, 5)}", sentence(rng, 30), prompt]
    items = [(i, f"{prompt} {sentence(rng, 3)}") for i in range(400)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    of_items = q.item_windows(benchmark)
    # what is broadcast has one row per window, of bounded width, however many items hold it
    assert q.distinct_windows(of_items).where("size(window) > 10").count() == 0
    shared = of_items.groupBy("number").count().where("count = 400")
    assert shared.count() == 3 and q.distinct_windows(of_items).join(shared, "number").count() == 3
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in q.judged(documents(texts), benchmark).collect()}
    assert got == brute(texts, items) and got[0][2] == got[2][2] == 400


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert q.judged(documents(["a b c"]).limit(0), benchmark).collect() == []
    assert [r.contaminated for r in q.judged(documents(["a b c", None]), benchmark.limit(0)).collect()] == [False, False]
    assert q.without_contaminated(documents(["a b c", None, "z"]), benchmark).count() == 2


def test_no_python_in_the_plan(spark, documents):
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = q.judged(documents(corpus()), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
