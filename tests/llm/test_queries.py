"""Every query of the subpackage on the smallest tables, against its SQL where there is one."""

import pytest

import __spark_entry__ as contract
from tenderlake.llm.queries import QUERIES
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted([*QUERIES, "pipeline"]))
def test_query_equals_sql(spark, db, name):
    assert name in contract.queries()
    assert compare(spark, db, FOLDER, name) is None
