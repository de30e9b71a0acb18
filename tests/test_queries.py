import pytest

from tellgrid import queries
from tests.conftest import rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
