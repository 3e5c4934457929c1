"""Every registered query beside its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import duck, mismatch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    assert mismatch(df, con, entry_module.oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    found = {(r.table, r.constraint): r.violations for r in rows}
    assert found[("public.lineitem", "primary")] > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
