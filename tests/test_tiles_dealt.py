"""Tiles are dealt to as many tasks as are set, and a line's steps are looked up where its tile is."""

import pytest
from pyspark.sql import functions as F

from glidemesh.operators import raster
from glidemesh.plans import rasters_all

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["R4_gradient_all", "R4_integrate_all"])
def test_tiles_are_not_packed_into_one_task(spark, name):
    """Before, all cells came to one task, as they pack into few bytes."""
    assert rasters_all.QUERIES[name](spark, SF).select(F.spark_partition_id()).distinct().count() > 1


def test_lines_over_one_tile_go_to_several_groups(spark, monkeypatch):
    """Before, each step of a line was a row that was dealt by its cell."""
    text = rasters_all.QUERIES["R7_direct_score_all"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in text and "r1#" not in text.split("CoGroup")[0]
    cells = spark.range(100).selectExpr("1L AS tile", "cast(id / 10 as long) AS r", "id % 10 AS c", "CASE WHEN id = 55 THEN -32768 ELSE 100L END AS elev")
    lines = spark.range(400).selectExpr("id AS pair", "CASE WHEN id % 100 = 0 THEN 2L ELSE 1L END AS tile", "id % 7 AS r0", "id % 10 AS c0", "id * 3 % 10 AS r1", "id * 7 % 10 AS c1", "1000D + id % 3 * 500 AS alt")
    rows = lambda: sorted(map(str, raster.direct_score(lines, cells, (278.0, 200.0)).collect()))
    whole = rows()
    monkeypatch.setattr(raster, "LINES", 50)
    assert rows() == whole and len(whole) == lines.where("r0 <> r1 or c0 <> c1").count()
    assert sum("ratio=None" in x for x in whole) > 4
