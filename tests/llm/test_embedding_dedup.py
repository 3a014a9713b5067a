from __future__ import annotations

import numpy as np
import pytest

from tallystone.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<double>, n long, unit string"


def around(rng: np.random.Generator, x: np.ndarray, cosine: float) -> np.ndarray:
    side = rng.normal(size=len(x))
    side -= side @ x * x
    return cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def vectors(seed: int = 3, n: int = 500, width: int = 24) -> list[tuple]:
    """Scattered vectors, pairs around the threshold, chains, a dense group, exact and scaled copies, odd rows."""
    rng = np.random.default_rng(seed)
    plain = rng.normal(size=(n, width))
    plain /= np.linalg.norm(plain, axis=1)[:, None]
    found = list(plain) + [around(rng, x, c) for x in plain[:150] for c in (0.88, 0.9001, 0.93, 0.985)]
    for _ in range(30):  # a chain, each linked to the one before
        found.append(around(rng, found[-1], 0.93))
    found += [around(rng, plain[7], 0.99) for _ in range(260)]
    found += [plain[3]] * 40 + [plain[3] * 2, plain[4] * 1e200, plain[5] * 1e-200]
    rows: list = [v.tolist() for v in found]
    rows += [None, [], [0.0] * width, [1.0, None] + [0.0] * (width - 2), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1.0], [2.0] + [0.0] * (width - 1)]
    order = rng.permutation(len(rows))
    ids: list = [int(i) for i in order]
    ids[5], ids[9], ids[10] = None, ids[11], None
    return list(zip(ids, rows))


def brute(rows: list[tuple], threshold: float = 0.9) -> tuple[list[tuple], np.ndarray, float]:
    width = max(len(v or []) for _, v in rows)
    units = [ed.unit(v, width) for _, v in rows]
    good = np.array([u is not None for u in units])
    points = np.array([np.zeros(width) if u is None else u for u in units])
    links = points @ points.T >= threshold
    links &= good[:, None] & good[None, :]
    np.fill_diagonal(links, False)
    label = np.arange(len(rows))
    while True:
        least = np.array([min(label[i], label[links[i]].min(initial=len(rows))) for i in range(len(rows))])
        if (least == label).all():
            break
        label = least
    result = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(label == label[i]) if rows[j][0] is not None]
        component = min(ids) if ids else None
        result.append((vec, int(links[i].sum()), component, vec == component))
    return result, links, links.sum()


@pytest.mark.parametrize("codewords, block", [(2, 2048), (6, 40), (1, 7)])
def test_every_link_of_full_recall(spark, codewords, block):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = ed.linked(frame, recall=1.0, codewords=codewords, block=block)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)[0]))


def test_recall_at_the_registered_setting_and_no_false_link(spark):
    rows = vectors(5, 1500)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = {r.vec_id: r for r in ed.linked(frame, codewords=8).collect()}
    want, links, total = brute(rows)
    assert all(got[i].n_links <= w[1] for i, w in enumerate(want))
    assert sum(r.n_links for r in got.values()) >= 0.97 * total
    # pairs outside the dense group alone
    sparse = links.sum(1) < 100
    assert sum(got[i].n_links for i in np.flatnonzero(sparse)) >= 0.97 * links[sparse].sum()
    assert all(got[i].component_id >= w[2] for i, w in enumerate(want))


def test_traversal_visits_cells_in_order_of_their_distance():
    rng = np.random.default_rng(1)
    for _ in range(20):
        first, second = rng.random(7), rng.random(5)
        radius = rng.random()
        cells = list(ed.traversal(first, second, radius))
        sums = [first[i] + second[j] for i, j in cells]
        assert sums == sorted(sums) and len(set(cells)) == len(cells)
        assert len(cells) == (first[:, None] + second[None, :] <= first.min() + second.min() + radius).sum()


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ed.linked(empty).collect() == []
    odd = spark.createDataFrame([(1, None, 1, "x"), (2, [0.0], 1, "x")], SCHEMA)
    assert sorted(tuple(r) for r in ed.linked(odd).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    one = spark.createDataFrame([(1, [3.0], 1, "x"), (2, [4.0], 1, "x"), (3, [-4.0], 1, "x")], SCHEMA)
    assert sorted(tuple(r) for r in ed.linked(one).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
