"""Every registered query against its SQL twin on the smallest data; the streams, which take longest, in test_streaming."""

from __future__ import annotations

import __spark_entry__ as registry
import pytest
from compare import difference
from conftest import SMALL

from tallystone.plans import catalog, oracles

STREAMS = [n for n in catalog.QUERIES if n.startswith("stream_")]


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(oracles.oracle_queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in STREAMS])
def test_query(spark, name):
    assert difference(spark, name, registry.queries()[name], registry.oracle_sql()[name], SMALL) is None
