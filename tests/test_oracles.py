"""Every registered query against its SQL, over whole tables at the smallest scale."""

import os

import pytest

from chatloom.plans import all_oracles, all_queries
from oracle_check import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


#: SQL can't express them; test_subwords holds the query against the tokenizers library.
BY_LIBRARY = {"subword_ids"}


def test_every_query_has_sql():
    assert set(all_queries()) - BY_LIBRARY == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    verdict, _, rows = compare(spark, con, SF, name, all_queries()[name], all_oracles().get(name))
    assert verdict in ("ok", "rows-only"), verdict
