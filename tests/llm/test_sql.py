import pytest

from barflow.llm.queries import ORACLES, QUERIES
from compare import difference

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), ORACLES[name], SMALL) is None
