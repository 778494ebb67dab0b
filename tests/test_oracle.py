"""Every query with a plain-SQL twin gives the same rows on the smallest tables; the others give rows."""
import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], ORACLE[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_names_match():
    assert set(ORACLE) <= set(entry.queries())
