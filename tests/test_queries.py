"""Every registered query against its SQL on the smallest tables (``TEST_SF_DIR`` picks others)."""

import os

import pytest

from casemill.queries import ALL
from oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    fn, sql = ALL[name]
    assert compare(spark, con, FOLDER, fn, sql) is None


def test_every_query_has_sql_or_a_unit_test():
    assert {name for name, (_, sql) in ALL.items() if sql is None} == {"label_probabilities", "label_scores"}
