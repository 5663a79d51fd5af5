"""Every registered query with an SQL twin gives the same rows as the twin."""

import os

import pytest

from loomset.plans import registry
from tests.oracle import compare, connect

FOLDER = os.environ.get("LOOMSET_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows(spark, con, name):
    compare(spark, con, FOLDER, registry.queries()[name], registry.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).columns
    registry.queries()[name](spark, FOLDER).count()


def test_twins_have_queries():
    assert set(registry.oracles()) <= set(registry.queries())
