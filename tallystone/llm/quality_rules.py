"""Quality rules as a learned decision list (native).

Sequential covering over labelled text statistics: a rule for bad documents is grown, one
threshold condition at a time, on two thirds of the labelled rows, pruned back on the
other third, and kept if it is still precise there; the rows it covers are taken out and the
next rule is grown. The result is an ordered list of readable threshold conjunctions, which
becomes one Spark conditional expression. Statistics are built-in functions over whole texts;
Python touches only the bounded sample of labelled statistics that the rules are fitted on.

Cases: a null text has no words, so it fails the base rules. Rows without a label, with a null
label, and labels without a document are not used for fitting. With no labels, or labels of one
class only, the list is empty and the base rules alone decide. Repeated rows are judged one by
one. Other columns are kept as they are, also when they are named like a statistic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import blank_words, column, free_name

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What conditions may test: the counts, and rates per word.
FEATURES = ("n_words", "word_length", "symbol_rate", "line_words", "dup_lines", "repeat_rate")

FIT_ROWS = 20_000
MIN_PRECISION = 0.9
MIN_COVER = 8
MAX_RULES = 16
MAX_CONDITIONS = 4
THRESHOLDS = 48


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, features: dict[str, Column]) -> Column:
        value = features[self.feature]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Column]:
    """``docs`` with one struct column of COUNTS and helpers, and that column.

    Repeated three-word windows are found by sorting (hash, place) pairs within the row; the
    windows of one text are told apart by a 64-bit hash."""
    words, hashes, places, stats = (free_name(docs, n) for n in ("_words", "_hashes", "_places", "_stats"))
    base = docs.withColumn(words, blank_words(column(docs, text)))
    n, word = F.size(words), F.col(words)
    windows = F.arrays_zip(F.slice(word, 1, n - 2), F.slice(word, 2, n - 2), F.slice(word, 3, n - 2))
    base = base.withColumn(hashes, F.when(n >= 3, F.transform(windows, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    h, m = F.col(hashes), F.size(hashes)
    # no window twice: nothing to look for, which a set tells faster than a sort
    repeats = F.size(F.array_distinct(h)) < m
    base = base.withColumn(places, F.when(repeats, F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), m - 1).alias("i")))))
    p = F.col(places)
    neighbours = F.arrays_zip(p.alias("a"), F.slice(p, 2, m).alias("b"))
    again = F.transform(F.filter(neighbours, lambda x: x["a"]["h"] == x["b"]["h"]), lambda x: F.sequence(x["a"]["i"], x["a"]["i"] + 2))
    later = F.transform(F.filter(neighbours, lambda x: x["a"]["h"] == x["b"]["h"]), lambda x: F.sequence(x["b"]["i"], x["b"]["i"] + 2))
    covered = F.size(F.array_distinct(F.flatten(F.concat(again, later))))
    whole = F.coalesce(column(base, text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    # explode() of the one struct keeps later filters above this point: pushed below, they
    # would compute the word array once per window
    out = base.withColumn(
        stats,
        F.explode(F.array(F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.concat_ws("", F.col(words))).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(p.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        ))),
    ).drop(words, hashes, places)
    return out, F.col(stats)


def features(stats: Column) -> dict[str, Column]:
    per_word = lambda name: stats[name] / F.greatest(stats["n_words"], F.lit(1))
    return {
        "n_words": stats["n_words"].cast("double"),
        "word_length": per_word("word_chars"),
        "symbol_rate": per_word("n_symbols"),
        "line_words": stats["n_words"] / F.greatest(stats["n_lines"], F.lit(1)),
        "dup_lines": stats["n_dup_lines"].cast("double"),
        "repeat_rate": per_word("n_repeat_words"),
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Features and label of at most ``rows`` labelled documents, those whose hashed id is
    smallest; the chosen ids are few by that bound, so they may be broadcast."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"), F.xxhash64("doc_id").alias("_at"))
        .where(F.col("_id").isNotNull() & F.col("_quality").isNotNull())
        .orderBy("_at", "_id", "_quality")
        .limit(rows)
    )
    joined = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(chosen), "_id")
    measured, stats = with_statistics(joined, "_text")
    return (
        measured.where(~base_failed(stats))
        .select("_at", "_id", *(c.alias(name) for name, c in features(stats).items()), (F.col("_quality") == 0).cast("int").alias("bad"))
        .orderBy("_at", "_id", *FEATURES)
        .limit(rows)
    )


def _covers(rule: Rule, table: dict[str, np.ndarray], rows: int) -> np.ndarray:
    inside = np.ones(rows, bool)
    for c in rule:
        inside &= table[c.feature] >= c.threshold if c.at_least else table[c.feature] < c.threshold
    return inside


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, least: int) -> Rule:
    """Add the condition with the largest information gain for the bad rows until none helps."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and inside.any() and not bad[inside].all():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best: tuple[float, Condition | None] = (1e-9, None)
        for feature in FEATURES:
            values = table[feature]
            cuts = np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, THRESHOLDS), method="nearest"))
            for cut in cuts:
                for at_least in (True, False):
                    side = inside & (values >= cut if at_least else values < cut)
                    p, n = int(bad[side].sum()), int((~bad[side]).sum())
                    if p < least or p + n == p0 + n0:
                        continue
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                    if gain > best[0]:
                        best = (gain, Condition(feature, at_least, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside = _covers(rule, table, len(bad))
    return rule


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule that does best on rows it was not grown on; its precision and cover."""
    found: tuple[float, Rule, float, int] = (-1.0, (), 0.0, 0)
    for k in range(len(rule), 0, -1):
        inside = _covers(rule[:k], table, len(bad))
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= found[0]:
            found = (worth, rule[:k], (p + 1) / (p + n + 2), p)
    return found[1:]


def fit(sample: DataFrame, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER) -> list[Rule]:
    """Ordered rules for bad documents from the bounded sample of ``labelled_sample``."""
    rows = sample.collect()
    table = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    bad = np.array([r["bad"] == 1 for r in rows], bool)
    third = np.arange(len(rows)) % 3 == 2
    grow = ({f: v[~third] for f, v in table.items()}, bad[~third])
    check = ({f: v[third] for f, v in table.items()}, bad[third])
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and grow[1].sum() >= min_cover and check[1].sum() > 0:
        rule = _grow(*grow, min_cover)
        if not rule:
            break
        rule, precision, cover = _prune(rule, *check)
        if not rule or cover < 2 or precision < min_precision:
            break
        rules.append(rule)
        grow, check = ((({f: v[out] for f, v in t.items()}, b[out])) for t, b in (grow, check) for out in [~_covers(rule, t, len(b))])
    return rules


def rule_number(rules: list[Rule], stats: Column) -> Column:
    """1-based number of the first rule that fits, else 0: the list as one conditional expression."""
    chain, known = None, features(stats)
    for k, rule in enumerate(rules, 1):
        met = rule[0].column(known)
        for condition in rule[1:]:
            met &= condition.column(known)
        chain = F.when(met, k) if chain is None else chain.when(met, k)
    return F.lit(0) if chain is None else chain.otherwise(0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the number of the rule that rejected (0: none)."""
    measured, stats = with_statistics(docs.select("doc_id", "text"))
    failed = base_failed(stats)
    rule = rule_number(rules, stats)
    return measured.select("doc_id", *(stats[c].alias(c) for c in COUNTS), failed.alias("base_failed"), (~failed & (rule == 0)).alias("kept"), rule.alias("rule"))


def kept(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that neither the base rules nor the list rejects, with all their columns."""
    measured, stats = with_statistics(docs)
    return measured.where(~base_failed(stats) & (rule_number(rules, stats) == 0)).select(*(column(measured, c) for c in docs.columns))


def learned(docs: DataFrame, labels: DataFrame, **limits: float) -> list[Rule]:
    return fit(labelled_sample(docs, labels), **limits)
