import pytest

from loomspan.queries import ORACLE, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    assert same(QUERIES[name](spark, sf), ORACLE[name], sf) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["word", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
