"""Every registered query against its SQL counterpart."""

import pytest

from opscheck.plans.oracles import ORACLES
from opscheck.plans.registered import QUERIES
from tests.compare import TESTDATA, compare, connect

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None
