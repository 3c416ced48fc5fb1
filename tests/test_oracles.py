"""Every query against its SQL in DuckDB; those without SQL give rows."""

import pytest
from duck import same

from lumenfold.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_sql(spark, data, name):
    same(core.queries()[name](spark, data), core.oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_rows(spark, data, name):
    assert core.queries()[name](spark, data).count() > 0
