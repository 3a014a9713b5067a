from __future__ import annotations

import pytest
from compare import difference
from conftest import SMALL

from tallystone.llm import registry


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, name, registry.queries()[name], registry.oracle_sql()[name], SMALL) is None
