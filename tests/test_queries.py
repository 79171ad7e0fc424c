"""Every query with oracle SQL gives the same rows in Spark and DuckDB; the others run with a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, assert_same, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLE:
        assert_same(df, con, ORACLE[name])
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["scan_id", "entity_type", "entity_id", "change_kind"]


def test_no_oracle_without_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_the_text_subpackage_is_not_needed():
    import subprocess
    import sys

    code = "import sys; sys.modules['cadastra.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p3_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)
