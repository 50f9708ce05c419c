"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import checks
from compare import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")
# These have too little to work on in the smallest tables to give any row.
MAY_BE_EMPTY = {"build_dataset", "huc_soil_moisture", "huc_drought_cells"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, FOLDER, name, checks.QUERIES[name], checks.SQL.get(name))
    if problem == "no rows" and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


def test_sql_belongs_to_queries():
    assert set(checks.SQL) <= set(checks.QUERIES)
