import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

from shatterlens.llm import queries  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(oracle.DATA).exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_equals_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, oracle.DATA).count() > 0
