"""Every query of the core against its SQL on the smallest tables; those without SQL must run and keep their columns."""

import __spark_entry__ as entry
import pytest
from compare import compare, duck

SMALL = "/root/testdata/sf0.001"
CORE = {}
for module in entry.CORE:
    registry = __import__(f"quillon.plans.{module}", fromlist=["registry"]).registry
    CORE.update({name: (fn, registry.sql.get(name)) for name, fn in registry.queries.items()})


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    fn, sql = CORE[name]
    if sql is None:
        assert fn(spark, SMALL).count() >= 0
    else:
        why, _ = compare(spark, con, SMALL, fn, sql)
        assert not why


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
