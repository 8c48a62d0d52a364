"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from conftest import SF
from fillgauge.queries import ORACLES, QUERIES
from tools.check_oracles import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, SF)
    assert ok, text


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 4
