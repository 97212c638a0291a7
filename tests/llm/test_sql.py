"""Corpus queries that SQL can express."""

import pytest

from registra.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(name, sf, same):
    same(name, sf)
