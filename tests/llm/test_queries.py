"""The registered queries over whole tables against their SQL."""

import pytest

from termlake.llm import queries
from tests.compare import differences

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(queries.queries()[name](spark, sf_dir), SQL[name], sf_dir) == ""


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    assert [n.partition("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert {*queries.queries(), "pipeline"} <= set(entry.queries())
