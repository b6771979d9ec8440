"""Every registered query against its SQL twin on the smallest given tables."""

import pytest
from conftest import SMALL

from workload import QUERIES
from workload.compare import connection, differences


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_twin(spark, con, name):
    assert differences(spark, con, SMALL, name) == []
