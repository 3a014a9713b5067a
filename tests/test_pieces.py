from __future__ import annotations

import random

import pyarrow as pa
import pytest

from tallystone.session import scratch_path
from tallystone.sources import pieces, statements


def written(folder, **files):
    import os

    os.makedirs(folder)
    for name, text in files.items():
        with open(f"{folder}/{name}.xml", "wb") as out:
            out.write(text if isinstance(text, bytes) else text.encode())
    return folder


def rows_of(frame):
    rows = [r.asDict() for r in frame.collect()]
    for r in rows:
        r["payload_id"] = r["payload_id"].rsplit("/", 1)[1]
    return sorted(str(sorted(r.items())) for r in rows)


def same(spark, folder, size):
    want = rows_of(statements.good_rows(whole := statements.parse_payloads(statements.read_payloads(spark, folder))))
    cut = pieces.parse_files(spark, folder, size)
    assert rows_of(statements.good_rows(cut)) == want
    reasons = lambda parsed: sorted((r.payload_id.rsplit("/", 1)[1], r.reason) for r in statements.rejected_payloads(parsed).collect())
    assert reasons(cut) == reasons(whole)
    return want


def long_statement(rng, statements_, head="", tail=""):
    parts = [f'<?xml version="1.0" encoding="UTF-8"?>\n<R><FlexStatements count="{statements_}">{head}']
    for s in range(statements_):
        parts.append(f'<FlexStatement accountId="U{s}" toDate="20260214">\n')
        for c in range(rng.randint(0, 4)):
            if rng.random() < 0.3:
                parts.append(f'<Empty{c} a="{c}"/>' if c % 2 else f"<Empty{c}></Empty{c}>")
                continue
            parts.append(f'<Section{c} currency="USD" note="é &amp; {c}">')
            for r in range(rng.randint(1, 9)):
                parts.append(f'<Group g="{r}"><Leaf q="{r}"/>text<Leaf q=\'x\' currency="EUR"></Leaf></Group>' if rng.random() < 0.3 else f'<Row id="{r}" /><!-- note -->')
            parts.append(f"</Section{c}>")
        parts.append("</FlexStatement>")
    return "".join(parts) + f"{tail}</FlexStatements></R>\n"


@pytest.mark.parametrize("size", [150, 1000, None])
def test_pieces_equal_whole_files(spark, size):
    rng = random.Random(3)
    folder = written(
        scratch_path(spark, "cut"),
        one=long_statement(rng, 12), two=long_statement(rng, 3).rstrip(), namespace='<R xmlns:f="u"><f:A/><FlexStatement><S f:x="1"><T/></S></FlexStatement></R>',
        wrong_count=long_statement(rng, 4).replace('count="4"', 'count="5"'),
        empty="", text_only="none", no_statement="<R>" + "<a/>" * 90 + "</R>",
        open_end=long_statement(rng, 6).rstrip()[:-4], crossed=long_statement(rng, 6).replace("</FlexStatement>", "</Other>", 1),
        two_roots=long_statement(rng, 2) + "<R/>" + " " * 400, late_text=long_statement(rng, 2) + " " * 300 + ">", closed_twice=long_statement(rng, 2) + "</R>",
    )
    assert len(same(spark, folder, size)) > 100


def test_files_that_tags_do_not_cut(spark):
    rng = random.Random(4)
    texts = {
        "quoted": long_statement(rng, 5, tail='<Other note="a > b"/>'),
        "comment": long_statement(rng, 5, head="<!-- <FlexStatement> is > this -->"),
        "cdata": long_statement(rng, 5, head="<![CDATA[ <a> ]]>"),
        "doctype": long_statement(rng, 5).replace("<R>", '<!DOCTYPE R [<!ENTITY e "v">]><R>', 1).replace('accountId="U1"', 'accountId="&e;"'),
        "plain": long_statement(rng, 5),
    }
    assert len(same(spark, written(scratch_path(spark, "irregular"), **texts), 200)) > 50


def test_starts_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_BROADCAST", 1)
    same(spark, written(scratch_path(spark, "shuffled"), one=long_statement(random.Random(5), 9), two="<R/>"), 300)


def test_other_encodings_are_reported(spark):
    text = '<?xml version="1.0" encoding="ISO-8859-1"?><R><FlexStatement a="ü"/></R>'.encode("latin-1")
    cut = pieces.parse_files(spark, written(scratch_path(spark, "latin"), one=text), 100)
    assert [r.reason for r in statements.rejected_payloads(cut).collect()] == [pieces.OTHER_ENCODING]


def test_a_file_is_read_by_many_tasks(spark):
    folder = written(scratch_path(spark, "many"), one=long_statement(random.Random(6), 40))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with pieces._piece_size(spark, 1000):
        assert pieces.records(spark, folder).select("piece").distinct().count() > 10
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_facts_of_a_lot_are_read_once_and_records_match_in_linear_time():
    """Neighbouring files that both start at byte 0 are lots of their own; a tag of many quoted values takes no step per letter."""
    batch = pa.RecordBatch.from_pydict({"payload_id": ["a", "a", "b", "b"], "piece": [0, 0, 0, 7], "record": [b"<x", b"</x", b"<y/", b"</z"], "file_bytes": [7, 7, 4, 4]})
    lots = list(pieces._runs(iter([batch])))
    assert [(key, lot) for key, lot, _ in lots] == [(("a", 0), [b"<x", b"</x"]), (("b", 0), [b"<y/"]), (("b", 7), [b"</z"])]
    assert all("record" not in first for _, _, first in lots)
    for record, simple in ((b"<a b='<'", False), (b'<a b="\'" c=\'"\'', True), (b'<a b="', False), (b"<a" + b' b="c"' * 1000, True)):
        assert (pieces._RECORD.fullmatch(record) is not None) is simple
    assert b"[^<\"']|" not in pieces._VALUE
