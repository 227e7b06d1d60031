"""The raster queries over tiles that grow with the table, each with its SQL twin.

``fixtures.CELLS`` has at most ten tiles whatever the table's size, and its SQL stays as it is;
these queries run the same operators over a tile for every block of order keys.
"""

from __future__ import annotations

from glidemesh.operators import matching as match
from glidemesh.operators import raster
from glidemesh.plans import matching, packs
from glidemesh.sources import fixtures as fx
from glidemesh.sources.fixtures import derive, plain

#: A whole tile of 48 x 48 cells for every block of 2,304 order keys.
CELLS = fx.CELLS.replace(
    "SELECT DISTINCT c_custkey % 1000 AS tile FROM {customer} WHERE c_custkey % 100 = 0",
    "SELECT DISTINCT cast(floor(o_orderkey / 2304) as bigint) AS tile FROM {orders}",
)
#: Points and lines over all tiles.
POINTS = matching.POINTS.replace("o_orderkey % 10 * 100 AS tile", "cast(floor(o_orderkey / 2304) as bigint) AS tile")
LINES = packs.LINES.replace("s_suppkey AS pair", "o_orderkey AS pair").replace("cast(0 as bigint) AS tile", "cast(floor(o_orderkey / 2304) as bigint) AS tile").replace("s_suppkey", "o_orderkey").replace("{supplier}", "{orders}")


def cells(s, d):
    return derive(s, d, CELLS)


QUERIES = {
    "R2_pool_max_all": lambda s, d: raster.pool_max(cells(s, d), 3, 4),
    "R4_gradient_all": lambda s, d: raster.raster_gradient(cells(s, d)),
    "R4_integrate_all": lambda s, d: raster.raster_integrate(raster.raster_gradient(cells(s, d))),
    "R5_tile_index_all": lambda s, d: raster.tile_index(cells(s, d)),
    "R7_direct_score_all": lambda s, d: raster.direct_score(derive(s, d, LINES), cells(s, d)),
    "J13_sample_cells_all": lambda s, d: match.sample_cells(derive(s, d, POINTS), cells(s, d)).select("point", "elev"),
}


def _all(sql: str) -> str:
    for old, new in ((fx.CELLS, CELLS), (matching.POINTS, POINTS), (packs.LINES, LINES)):
        sql = sql.replace(plain(old), plain(new))
    return sql


ORACLES = {name: _all({**packs.ORACLES, **matching.ORACLES}[name.removesuffix("_all")]) for name in QUERIES}
