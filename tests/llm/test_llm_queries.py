"""The queries of the problems on the smallest tables, with SQL where there is any."""

import pytest

from tandemlab.llm import queries
from tests.util import connect, rows


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, smallest, name):
    got = queries.QUERIES[name](spark, smallest).toPandas()
    if name in queries.SQL:
        db = connect(smallest)
        want = db.execute(queries.SQL[name]).df()
        db.close()
        assert rows(got) == rows(want)
    assert len(got) == len(got.drop_duplicates())
