import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest

from millrace import queries as core
from oracle import assert_same

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_against_oracle(spark, sf_dir, name):
    assert_same(spark, sf_dir, core.queries()[name], SQL[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    df = core.queries()["scan_project_filter"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan or "GreaterThan(o_totalprice" in plan
    assert "o_orderdate" not in plan
