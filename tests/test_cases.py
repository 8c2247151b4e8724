"""The rules of lines and items on cases whose results are written out by hand, where a query of the same name now reads a table's own columns."""

import pytest

from tests.oracle import differences

from tessera.plans import articles, columns, filings

CASES = {k: (p.QUERIES[k], p.SQL[k]) for p in (filings, articles) for k in p.SQL if k in columns.SQL}


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, small, name):
    assert differences(spark, *CASES[name], small) == ""
