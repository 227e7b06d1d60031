"""Steps of paths are looked up where the window is; they are never rows, whatever the paths' number."""

import numpy as np
import pytest

from glidemesh.operators import routing as rt
from glidemesh.operators import walks
from glidemesh.plans import routing, routing_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("plan,name", [(routing, "R10_score_paths"), (routing, "R13_profiles"), (routing_sql, "R12_R14_choose_describe")])
def test_steps_are_not_shuffled(spark, plan, name):
    """Before, each step was a row that was dealt by its cell."""
    text = plan.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in text and "explode" not in text


def test_cells_of_any_rows_and_columns():
    cells = walks.Cells(np.array([-3.0, 5, 5]), np.array([2.0, -7, -7]), np.array([10.0, 30, 20]), lowest=True)
    got = cells.at(np.array([-3.0, 5, 9, -3]), np.array([2.0, -7, 9, -7]))
    assert got[:2].tolist() == [10.0, 20.0] and np.isnan(got[2:]).all()
    none = np.zeros(0)
    assert np.isnan(walks.Cells(none, none, none).at(np.array([1.0]), np.array([1.0]))).all()


def test_paths_without_nodes_or_with_one_and_bends_in_place(spark):
    grid = spark.range(10).selectExpr("0L AS solve_id", "-2L AS r", "id AS c", "CASE WHEN id = 8 THEN -32768 ELSE 100 END AS elev")
    solves = spark.createDataFrame([(0, -2, 0, 1000.0, 300.0, 200.0)], "solve_id long, r0 long, c0 long, alt_m double, north_m double, east_m double")
    targets = spark.createDataFrame([(0, i, -2, 5, 50.0) for i in range(5)], "solve_id long, target_id long, r long, c long, elev_m double")
    at = lambda *c: [(-2, x) for x in c]
    paths = spark.createDataFrame([(0, 0, None), (0, 1, at(0)), (0, 2, at(0, 3, 3, 7)), (0, 3, at(0, 9)), (0, 9, at(0, 1))], "solve_id long, target_id long, nodes array<struct<r:long,c:long>>")
    got = {r.target_id: r for r in rt.score_paths(paths, grid, solves, targets).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0].nodes, got[0].length_m, got[0].ratio) == (None, None, None) and (got[1].length_m, got[1].ratio) == (0.0, 0.0)
    assert got[2].length_m == 1400.0 and got[2].ratio == 2.0 and got[2].critical is None  # 1400 m over 700 m left
    assert got[3].length_m == 1800.0 and got[3].ratio is None  # over a cell of unknown height
    shown = {r.target_id: r for r in rt.profiles(paths, grid, solves, 4).collect()}
    assert sorted(shown) == [2, 3, 9] and shown[3].terrain == [100, 100, 100, 100] and shown[3].length_m == 1800.0
