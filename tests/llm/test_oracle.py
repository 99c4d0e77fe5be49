import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from oracle import assert_same

from millrace.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, llm.queries()[name], llm.oracle_sql()[name])
