"""Every registered numerical query against its SQL, on the smallest tables."""

import pytest
from conftest import DATA, rows_of

from tallframe.plans import catalogue

NAMES = sorted(catalogue.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)
