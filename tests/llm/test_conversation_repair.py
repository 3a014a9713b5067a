from __future__ import annotations

import hashlib
import itertools
import random

import duckdb
import pyarrow as pa
import pytest

from tallystone.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, gone_by string, part int"


def conversations(seed: int = 7) -> list[tuple]:
    """Short ones, one of many turns, ties, repeated rows, nulls everywhere, odd roles, empty and very long texts."""
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "usher"]
    texts = ["Yes.", "No!", "so", "", " \t\n", None, "Well.", "Why?", "é ñ.", "word " * 30_000 + ".", "x" * 50_000]
    rows = [(c, t, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}.") for c in range(25) for t in range(rng.randint(1, 8))]
    rows += [(99, t * (1 + t % 2), "user" if t % 2 else "assistant", f"{t % 90}{rng.choice('. ')}") for t in range(300)]
    rows += [(None, t, "user", f"n{t}.") for t in range(3)] + [(2**60 + 1, None, "user", "a."), (2**60 + 1, None, "assistant", "b."), (2**60 + 1, -5, None, "c.")]
    return rows + rows[:5] + rows[30:40] * 2


def table(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])})


@pytest.mark.parametrize("options", [{}, {"partitions": 1}, {"partitions": 9, "block": 3}, {"partitions": 40, "block": 7}])
def test_whole_result_equals_the_turn_by_turn_program(spark, options):
    rows = conversations()
    con = duckdb.connect()
    con.register("conversations", table(rows))
    want = sorted(con.execute(cr.ORACLE).fetchall(), key=str)
    got = cr.judged(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def brute(turns: list[tuple[str, str | None]]) -> tuple[int, str]:
    """All edit strings of few insertions, tried one by one."""
    found = []
    for extra in range(5):
        for length in range(len(turns), len(turns) + extra + 1):
            for audit in itertools.product("DIKR", repeat=length):
                if sum(e != "I" for e in audit) == len(turns):
                    found += costs(audit, turns)
        if found and min(found)[0] <= 2 * extra:  # more insertions cost more than that
            break
    return min(found)


def costs(audit: tuple[str, ...], turns: list[tuple[str, str | None]]) -> list[tuple[int, str]]:
    ways = [("", 0)]
    rest = iter(turns)
    for edit in audit:
        initial, fault = ("", None) if edit == "I" else next(rest)
        if edit in "KR" and fault in ("blank", "duplicate"):
            return []
        late = int(fault == "truncated")
        made = {"D": [("", 3)], "I": [("u", 2), ("a", 2)], "K": [(initial or "-", late)], "R": [("u", 2 + late), ("a", 2 + late)]}[edit]
        ways = [(said + more, cost + price) for said, cost in ways for more, price in made]
    return [(cost, "".join(audit)) for said, cost in ways if legal(said)]


def legal(said: str) -> bool:
    body = said[1:] if said[:1] == "s" else said
    return said == "" or bool(body) and body == "ua" * (len(body) // 2)


def test_cheapest_edits_equal_all_edits_tried(spark):
    kinds = [("u", None), ("a", None), ("s", None), ("x", "truncated"), ("a", "truncated"), ("u", "blank"), ("s", "duplicate")]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n) if n < 3 else random.Random(3).sample(list(itertools.product(kinds, repeat=3)), 25):
            steps = [cr.turn_edges(*t) for t in turns]
            assert cr.cheapest(steps) == brute(list(turns)), turns
            assert cr.cheapest(steps, block=1) == cr.cheapest(steps)


def test_repaired_turns_follow_the_pattern_and_the_digest(spark):
    rows = [(*r, "x", 1) for r in conversations(8)]
    damaged = cr.damaged(spark.createDataFrame(rows, SCHEMA))
    digests = {r.conv_id: r.repaired_sha256 for r in cr.repairs(damaged, partitions=7, block=5).collect()}
    turns: dict = {}
    for r in cr.repaired_turns(damaged, partitions=7, block=5).collect():
        turns.setdefault(r.conv_id, []).append((r.seq, r.role, r.text))
    for conv, digest in digests.items():
        lines = sorted(turns.get(conv, []))
        assert [n for n, _, _ in lines] == list(range(len(lines)))
        assert legal("".join(role[:1] for _, role, _ in lines))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in lines).encode()).hexdigest() == digest


def test_empty_table_and_a_conversation_that_loses_all_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cr.judged(empty).collect() == []
    lost = spark.createDataFrame([(1, 1, "user", "a.", True), (1, 2, "user", "b.", True)], "conv_id int, turn int, role string, text string, gone boolean")
    assert [tuple(r) for r in cr.repairs(lost).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
