import pytest

from tests.oracle import DATA, compare
from tidelog.queries import ORACLE_SQL, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) > 0
