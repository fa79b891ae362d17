"""Every registered graph query builds, and the flagship returns rows."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"name", "n", "total"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
