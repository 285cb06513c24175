"""The SQL of the operators that have one."""

import pytest

from staywise.llm import queries
from tests.oracle_check import duck, rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    want = duck(SF).execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
