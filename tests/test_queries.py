"""Every registered query beside its SQL, and the rows-only ones for shape."""

import pytest

from clientlens.plans import oracles, queries
from tests.compare import compare, duck

SQL = oracles.oracle_sql()
SLOW = {"training_run"}  # the whole job; test_training_run runs it with smaller options


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_exact_query_has_sql():
    assert set(queries.EXACT) == set(SQL)


@pytest.mark.parametrize("name", sorted(queries.EXACT))
def test_matches_sql(name, spark, folder, con):
    assert compare(spark, con, folder, queries.EXACT[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.ROWS_ONLY) - SLOW))
def test_gives_rows(name, spark, folder):
    assert queries.ROWS_ONLY[name](spark, folder).take(1)
