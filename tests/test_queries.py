"""Every query runs; where there is SQL, it gives the same rows (smallest tables)."""

import importlib
import os

import pytest

from patchmill import plans
from tests.helpers import same_rows, views

D = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"patchmill.plans.{m}") for m in plans.MODULES]
CASES = [(n, m) for m in MODULES for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return views(D)


@pytest.mark.parametrize("name,module", CASES, ids=[n for n, _ in CASES])
def test_query(spark, con, name, module):
    df = module.QUERIES[name](spark, D)
    if name in module.SQL:
        same_rows(df, con, module.SQL[name])
    else:
        assert df.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
