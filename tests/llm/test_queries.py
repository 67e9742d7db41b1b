"""The registered queries: names, columns, and SQL where there is any."""

import pytest

from clickloom.llm.queries import ORACLE, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.01"


def test_one_query_per_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None
