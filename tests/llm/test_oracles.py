import pytest

from folioframe.llm.registry import ORACLES, QUERIES
from tests.oracle import matches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert matches(spark, QUERIES[name], ORACLES[name], SF)
