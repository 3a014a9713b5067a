from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F
from llm.texts import corpus, prose

from tallystone.llm import quality_rules as q


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, documents):
    texts = [*corpus(), "#a *b $c # # |", "same line\nother\nsame line\n \n \n"]
    for r in q.judged(documents(texts), []).collect():
        want = counts(texts[r.doc_id])
        assert tuple(r[c] for c in q.COUNTS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept != r.base_failed and r.rule == 0


def labelled(spark, documents, n=400):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        text, bad = prose(rng, 8), i % 4 == 0
        texts.append(text.replace(" ", "### ") if bad else text)
        labels.append((i, 0 if bad else 1, 0))
    frame = spark.createDataFrame(labels + [(None, 1, 0), (7_000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    return documents(texts), frame


def test_learned_list_separates_held_out_rows(spark, documents):
    docs, labels = labelled(spark, documents)
    rules = q.learned(docs.where("doc_id < 200"), labels)
    assert rules and all(c.feature in q.FEATURES for rule in rules for c in rule)
    wrong = q.judged(docs.where("doc_id >= 200"), rules).where(F.col("kept") != (F.col("doc_id") % 4 != 0))
    assert wrong.count() == 0
    assert {r.doc_id for r in q.kept(docs, rules).collect()} == {i for i in range(400) if i % 4}
    assert q.kept(docs, rules).columns == docs.columns


def test_without_labels_or_classes_or_rows(spark, documents):
    docs, labels = labelled(spark, documents, 30)
    assert q.learned(docs, labels.limit(0)) == []
    assert q.learned(docs, labels.where("quality = 1")) == []
    assert q.judged(docs.limit(0), []).collect() == []


def test_no_python_in_the_plan(spark, documents):
    plan = q.judged(documents(corpus()), [])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
