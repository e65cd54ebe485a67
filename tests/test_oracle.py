"""Every registered query against its SQL twin, at the smallest scale."""

import os

import pytest

from cadastre.plans import QUERIES
from tests.compare import compare, oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None
