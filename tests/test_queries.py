import pytest

from assayer.plans import catalogue
from tests.same import assert_same, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(name, spark, folder, con):
    assert_same(catalogue.queries()[name](spark, folder), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(name, spark, folder):
    df = catalogue.queries()[name](spark, folder)
    assert df.columns and df.collect()


def test_entry(spark, folder):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
