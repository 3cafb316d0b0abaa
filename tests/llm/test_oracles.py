import pytest
from compare import connect, same

from lodestrata.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_the_oracle(spark, name):
    same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
