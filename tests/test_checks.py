"""Every registered query against its SQL equivalent on the small tables."""

import pytest
from compare import connect, differences

from conftest import FOLDER
from dawnchorus.testbed.catalog import QUERIES, SQL

_LINK = {}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    if "con" not in _LINK:
        _LINK["con"] = connect(FOLDER)
    rows = QUERIES[name](spark, FOLDER).toPandas()
    assert len(rows) > 0
    if name in SQL:
        assert differences(rows, _LINK["con"].sql(SQL[name]).df()) == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
