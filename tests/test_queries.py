"""Every registered query on the smallest tables, beside its SQL."""

import pytest

import __spark_entry__ as e
from tools_compare import compare, connect

from conftest import SF


@pytest.fixture(scope="module")
def con():
    return connect(SF)


CORE = {k for m in (e.problems, e.reference) for k in m.QUERIES}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    ok, said = compare(spark, con, SF, name, e.oracle_sql().get(name))
    assert ok, said


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
