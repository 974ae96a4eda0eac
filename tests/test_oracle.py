"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle import TESTDATA, compare, connect
from pagetables.plans import QUERIES

FOLDER = str(TESTDATA / "sf0.001")
SPARSE = {"cursor_limit_warnings": str(TESTDATA / "sf0.01")}  # no rows at the smallest scale


@pytest.fixture(scope="module")
def con():
    return {folder: connect(folder) for folder in {FOLDER, *SPARSE.values()}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    folder = SPARSE.get(name, FOLDER)
    assert compare(spark, name, folder, con[folder]) == ""


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
