"""The operators' queries against their SQL on the smallest tables."""

import pytest

from beatloom.llm.queries import QUERIES, SQL
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), connect(SF).execute(SQL[name]).df()) is None
