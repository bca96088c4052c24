"""The operators that SQL can express give the statements' rows."""

import pytest

from corpusmill.llm import registry
from tests import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, small, name):
    got = registry.QUERIES[name](spark, small)
    want = compare.connect(small).sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got.columns, got.collect()) == compare.rows(want.columns, want.fetchall())
