"""Every registered query against its independent SQL statement."""

import compare
import pytest

import __spark_entry__ as entry_module

QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert compare.differences(result, con, ORACLE[name]) == ""
    else:
        assert result.count() > 0
