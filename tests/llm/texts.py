"""Small corpora: copies, shared passages, odd texts."""

from __future__ import annotations

import random

VOCABULARY = [a + b for a in ("an", "the", "or", "in", "é", "ti", "st", "ou") for b in ("ing", "er", "ly", "ñ", "tion", "a", "es")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def prose(rng: random.Random, lines: int, words: int = 12) -> str:
    return "\n".join(sentence(rng, words) for _ in range(lines))


def corpus(seed: int = 1, n: int = 24) -> list[str | None]:
    """Prose with exact and near copies, passages shared by several texts, repeats within a text,
    and null, empty, blank, one-word and very long texts."""
    rng = random.Random(seed)
    passage = prose(rng, 6)
    found: list[str | None] = [prose(rng, rng.randint(2, 14)) for _ in range(n)]
    found += [found[0], found[0], found[1].replace("ing", "ang", 1)]
    found += [prose(rng, 3) + "\n" + passage + "\n" + prose(rng, 2) for _ in range(3)]
    found += [passage + "\n" + prose(rng, 1) + "\n" + passage, passage]
    found += [None, "", "  \n\t ", "word", "word", "x " * 500, "a\n" * 300, prose(rng, 700)]
    return found
