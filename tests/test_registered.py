"""Every registered query that has no SQL runs, and gives rows and distinct column names."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(q for q in entry.queries() if q not in entry.oracle_sql() and not q.startswith("op") and q != "pipeline")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    rows = entry.queries()[name](spark, SF)
    assert len(set(rows.columns)) == len(rows.columns) and not rows.isEmpty()
