"""Training-text queries beside their SQL twins; the others must run."""

import os

import pytest

from loomset import llm
from tests.oracle import compare, connect

FOLDER = os.environ.get("LOOMSET_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(llm.oracles()))
def test_same_rows(spark, name):
    compare(spark, connect(FOLDER), FOLDER, llm.queries()[name], llm.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracles())))
def test_runs(spark, name):
    df = llm.queries()[name](spark, FOLDER)
    assert df.columns
    rows = df.collect()
    assert len(rows) == len({tuple(map(repr, r)) for r in rows})
