"""Every registered query against its SQL twin, or for rows when it has none."""

import pytest

from check_queries import compare, duck
from lendframe import queries

queries.load_all()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_every_twin_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
