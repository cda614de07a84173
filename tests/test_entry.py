"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connection, differences
from norrsken.plans.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.count() > 0 and "rank" in df.columns


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    notes = differences(spark, con, queries()[name], oracle_sql()[name], SF)
    assert not [n for n in notes if n != "no rows"], notes
