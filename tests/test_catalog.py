"""Every query of the catalog against its SQL, over whole tables."""

import pytest

from termlake import catalog
from tests.compare import differences


def test_each_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.SQL.keys()


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name], sf_dir) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
