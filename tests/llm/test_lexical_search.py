from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from llm.texts import corpus, prose

from tallystone.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    texts = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in texts]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(term for _, c in texts for term in c)
    result = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scores = []
        for (doc, counts), length in zip(texts, lengths):
            m = 100 - 25 + (25 * length * n) // total if total else 1
            score = 0
            for term, r in asked.items():
                if tf := counts[term]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                    score += r * w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        result += [(item, rank + 1, d if known else None, -score) for rank, (score, known, d) in enumerate(sorted(scores)[:k])]
    return sorted(result, key=str)


def fixture() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(5)
    texts = corpus(5, 60) + ["É Éa ÄÄ x1y2 İstanbul K", "the The THE the-the_the", "rare needle", "needle " * 50 + "the " * 9000]
    docs = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    docs += docs[:5] + [(None, "needle in the ing"), (None, "needle in the ing"), (2**60 + 1, "needle in the ing"), (-3, "needle in the ing")]
    items = [(i, prose(rng, 2, 9)) for i in range(8)] + [(8, "the needle"), (8, "the needle"), (9, None), (10, ""), (None, "rare rare needle éa"), (11, "nothingofthis"), (12, prose(rng, 400))]
    return docs, items


@pytest.mark.parametrize("k, query_chars, rows, spread, short", [(20, 10**6, 1000, 1, 8), (3, 300, 7, 3, 8), (1, 10**6, 5, 2, 2), (500, 10**6, 16, 2, 1000)])
def test_ranks_equal_all_scores_sorted(spark, monkeypatch, k, query_chars, rows, spread, short):
    monkeypatch.setattr(ls, "SHORT", short)
    monkeypatch.setattr(ls, "RANGE", 3)
    docs, items = fixture()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        d = spark.createDataFrame([(*x, "s", 1) for x in docs], "doc_id long, text string, score string, q int").repartition(spread)
        i = spark.createDataFrame([(*x, "s", 1) for x in items], "item_id long, text string, size string, part int")
        got = sorted((tuple(r) for r in ls.searched(d, i, k, query_chars).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{name} long, text string") for name in ("doc_id", "item_id"))
    full = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ls.searched(docs, full.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert ls.searched(full, items).collect() == []
    assert ls.searched(full.where("text is null"), full.withColumnRenamed("doc_id", "item_id")).collect() == []
