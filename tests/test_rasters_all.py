import pytest

from glidemesh.plans import rasters_all
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(set(rasters_all.QUERIES) - {"R7_direct_score_all"}))
def test_query_equals_sql(spark, name):
    got, want = rows_of_spark(rasters_all.QUERIES[name](spark, SF)), rows_of_duckdb(rasters_all.ORACLES[name], SF)
    assert got == want and got[1]


def test_direct_score_equals_sql(spark):
    small = "/root/testdata/sf0.001"
    got = rows_of_spark(rasters_all.QUERIES["R7_direct_score_all"](spark, small))
    assert got == rows_of_duckdb(rasters_all.ORACLES["R7_direct_score_all"], small) and got[1]


def test_tiles_grow_with_the_table(spark):
    tiles = [rasters_all.QUERIES["R5_tile_index_all"](spark, f"/root/testdata/sf{sf}").count() for sf in ("0.001", "0.01", "0.1")]
    assert tiles == [1, 7, 66]
    lines = rasters_all.derive(spark, SF, rasters_all.LINES)
    assert lines.select("tile").distinct().count() == 7
