from __future__ import annotations

import random
import re

import corpus_pipeline
import xxhash
from llm.texts import corpus, prose

from tallystone.llm import simhash_dedup as q
from tallystone.llm.components import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_linked_equals_brute_force(spark, documents):
    texts = corpus(3)
    rng = random.Random(0)
    for _ in range(60):  # texts that differ in one word of many
        words = texts[rng.randrange(10)].split(" ")
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += ["one Two", "ONE two", None]
    prints = [fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = closure(pairs, range(len(texts)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.linked(documents(texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in range(len(texts))}
    assert len(pairs) > 30
    assert q.linked(documents(texts).limit(0)).collect() == []


def test_ring_finds_every_pair_within_the_radius(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        values.add(x)
        for n in (1, 2, 3, 3, 4):
            y = x
            for bit in rng.sample(range(64), n):
                y ^= 1 << bit
            values.add(y)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(sorted(r)) for r in q.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    m = (1 << 64) - 1
    assert got == {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a & m) ^ (b & m)).bit_count() <= 3}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (101, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_near_copies_go_and_others_stay(spark, documents):
    rng = random.Random(9)
    texts, group = [], []
    for g in range(60):
        lines = [" ".join(f"{rng.randrange(10**6)}" for _ in range(12)) for _ in range(20)]
        for _ in range(3):
            words = " ".join(lines).split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
            group.append(g)
    texts += [texts[0], None, "", " ", "short", "short"]
    out = q.without_near_copies(documents(texts))
    kept = {r.doc_id for r in out.collect()}
    per_group = [sum(group[i] == g for i in kept if i < len(group)) for g in range(60)]
    assert min(per_group) >= 1 and sum(n == 1 for n in per_group) >= 57
    assert len(kept & {181, 182, 183}) == 1 and len(kept & {184, 185}) == 1 and 180 not in kept
    assert out.columns == documents(texts).columns
    twice = documents(texts[:6]).unionByName(documents(texts[:6]))
    assert q.without_near_copies(twice).count() == 2
    assert q.without_near_copies(twice.limit(0)).count() == 0


def test_hot_keys_meet_in_two_steps(spark, documents, monkeypatch):
    rng = random.Random(4)
    words = prose(rng, 30).split()
    texts = [" ".join([*words[:i], "w", *words[i + 1 :]]) for i in range(60)]
    monkeypatch.setattr(q, "HOT", 5)
    assert q.without_near_copies(documents(texts)).count() == 1


def test_near_copies_equal_brute_force_pairs(spark, documents, monkeypatch):
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        words = [f"{rng.randrange(10**6)}" for _ in range(rng.choice((60, 150, 400)))]
        for _ in range(8):  # copies of copies on both sides of the similarity
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.002, 0.035)))):
                changed[at] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
            if rng.random() < 0.3:
                words = changed
    sets = [set(q.shingle_set(t).tolist()) for t in texts]
    alike = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}
    pairs = [p for p, s in alike.items() if s >= 0.8]
    assert len(pairs) > 100 and sum(0.8 <= s < 0.84 for s in alike.values()) > 20 and sum(0.7 < s < 0.8 for s in alike.values()) > 100
    label = closure(pairs, range(len(texts)))
    for hot, block in ((q.HOT, q.BLOCK), (3, 4)):
        monkeypatch.setattr(q, "HOT", hot)
        monkeypatch.setattr(q, "BLOCK", block)
        assert {r.doc_id for r in q.without_near_copies(documents(texts)).collect()} == set(label.values())


def test_a_link_between_followers_is_found():
    import numpy as np
    import pandas as pd

    def bits(*at):
        return np.packbits([b in at for b in range(576)], bitorder="little").tobytes()

    # b is near a and c, c is not near a
    rows = pd.DataFrame({"part": 1, "fp": [bits(), bits(*range(100)), bits(*range(200))]})
    found = pd.concat(q._linked(iter([rows]), 110, None))
    assert len(found) == 2


def test_fingerprints_on_the_ring_are_near_copies(spark, documents):
    """Texts within three bits are links of the pipeline's stage, though their sets of shingles are not alike."""
    rng = random.Random(5)
    usual = " ".join(["row of dots"] * 400)
    texts = [f"{usual} {prose(rng, 30)}" for _ in range(4)] + [prose(rng, 60) for _ in range(4)]
    prints = [fingerprint(t) for t in texts]
    sets = [set(q.shingle_set(t).tolist()) for t in texts]
    pairs = [(i, j) for i in range(8) for j in range(i)]
    near = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert len(near) == 6 and all(len(sets[i] & sets[j]) < 0.5 * len(sets[i] | sets[j]) for i, j in pairs)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, documents(texts), "").collect()} == set(closure(near, range(8)).values())
