import pytest

from glidemesh.plans import routing, routing_sql
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(routing_sql.ORACLES))
def test_query_equals_sql(spark, name):
    run = {**routing.QUERIES, **routing_sql.QUERIES}[name]
    got, want = rows_of_spark(run(spark, SF)), rows_of_duckdb(routing_sql.ORACLES[name], SF)
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [x for x in zip(got[1], want[1]) if x[0] != x[1]][:3] == [] and got[1]
