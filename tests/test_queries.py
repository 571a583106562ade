import pytest

from loomlog.plans.oracles import ORACLE_SQL
from loomlog.plans.queries import QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Where the order of keys as text and as numbers differ only on more rows.
LARGER = ["state_first_match", "state_rows_ordered"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    compare(spark, SF, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", LARGER)
def test_equals_sql_on_more_rows(spark, name):
    compare(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name])
