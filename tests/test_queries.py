import pytest

from oracle import rows_of, rows_of_sql
from velado.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(SQL[name], sf_dir)
