import pytest
from oracle import SF, same

from marlstone.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), SQL[name])
