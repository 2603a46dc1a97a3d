"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest
from conftest import SF, duck, rows_of

from varloom.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = rows_of(got), rows_of(want)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(q))) for p, q in zip(x, y, strict=True)), (x, y)
