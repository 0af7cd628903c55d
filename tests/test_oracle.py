import pytest

from tessella.plans.catalog import ORACLE, QUERIES
from tests.comparing import duck, duck_rows, spark_rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert rows
    if name in ORACLE:
        expected_names, expected = duck_rows(con, ORACLE[name])
        assert names == expected_names
        assert rows == expected
