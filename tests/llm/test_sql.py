"""Queries of the corpus operators against their SQL."""

import pytest

from lexmill.llm import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, same):
    same(registry.queries()[name], ORACLES[name])
