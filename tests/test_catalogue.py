import pytest

from oracle import compare
from spindle.jobs import catalogue

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF) > 0
