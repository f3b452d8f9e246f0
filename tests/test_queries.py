import pytest

from tagloom.plans import catalogue, oracles

from .conftest import DATA, same_rows

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    if name in SQL:
        same_rows(df, duck, SQL[name])
    else:
        assert df.columns
        df.collect()


def test_entry_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
