"""Training-data queries against their SQL, or their row counts where SQL cannot express them."""

import os

import pytest
from oracle import compare, connect

from tessera.llm import catalog

DIRECTORY = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, name):
    compare(spark, connect(DIRECTORY), DIRECTORY, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIRECTORY).count() >= 0
