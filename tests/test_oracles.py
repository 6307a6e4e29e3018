from pathlib import Path

import oracle
import pytest

from shatterlens.plans import data_quality, file_queries, graph_queries, record_queries, table_queries

PARTS = (data_quality, file_queries, graph_queries, record_queries, table_queries)
SQL = {k: (p.QUERIES[k], s) for p in PARTS for k, s in p.ORACLES.items()}
WITHOUT = {k: f for p in PARTS for k, f in p.QUERIES.items() if k not in p.ORACLES}
pytestmark = pytest.mark.skipif(not Path(oracle.DATA).exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, name):
    oracle.same(spark, *SQL[name])


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, name):
    assert WITHOUT[name](spark, oracle.DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
