import pytest

from glidemesh.plans import matching, packs, records, sites
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"
ALL = {**sites.ORACLES, **packs.ORACLES, **matching.ORACLES, **records.ORACLES}
RUN = {**sites.QUERIES, **packs.QUERIES, **matching.QUERIES, **records.QUERIES}


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_sql(spark, name):
    got, want = rows_of_spark(RUN[name](spark, SF)), rows_of_duckdb(ALL[name], SF)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and got[1][:3] == want[1][:3]
    assert got[1] == want[1]
    assert got[1] or name == "A4_merge_freqs"  # its fixture is empty at this size
