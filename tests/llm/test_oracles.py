import pytest
from compare import differences, duck

from ledgerlens.llm import queries


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name, folder):
    assert differences(queries.QUERIES[name](spark, folder), duck(folder), queries.ORACLES[name]) == []
