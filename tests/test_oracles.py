import pytest

from folioframe.plans import catalog_io, catalog_sheets, catalog_text
from tests.oracle import matches

SF = "/root/testdata/sf0.001"
ALL = {**catalog_text.QUERIES, **catalog_sheets.QUERIES, **catalog_io.QUERIES}
SQL = {**catalog_text.ORACLES, **catalog_sheets.ORACLES, **catalog_io.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert matches(spark, ALL[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, SF).count() > 0


def test_entry_imports():
    import __spark_entry__

    assert set(ALL) <= set(__spark_entry__.queries())
