"""Registered queries over routes; a window for every block of order keys, targets from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.operators import routing as rt
from glidemesh.plans.rasters_all import CELLS
from glidemesh.sources.fixtures import derive, plain

QUERIES, ORACLES = {}, {}

GRID = f"SELECT tile AS solve_id, r, c, elev FROM ({CELLS}) g"
SOLVES = """SELECT DISTINCT cast(floor(o_orderkey / 2304) as bigint) AS solve_id, cast(40 as bigint) AS r0, cast(8 + floor(o_orderkey / 2304) % 30 as bigint) AS c0,
  cast(1600 + floor(o_orderkey / 2304) % 5 * 150 as double) AS alt_m, cast(278 as double) AS north_m, cast(262 as double) AS east_m FROM {orders}"""
TARGETS = """SELECT cast(floor(o_orderkey / 2304) as bigint) AS solve_id, o_orderkey AS target_id, o_orderkey * 5 % 40 + 6 AS r, o_orderkey * 11 % 48 AS c,
  cast(600 + o_orderkey % 90 as double) AS elev_m FROM {orders}"""
#: Polylines with one bend, from the origin to each target.
BENT = f"""SELECT s.solve_id, t.target_id, s.r0, s.c0, t.target_id % 19 + 25 AS rm, t.target_id * 3 % 48 AS cm, t.r, t.c, t.elev_m, s.alt_m, s.north_m, s.east_m
  FROM ({SOLVES}) s JOIN ({TARGETS}) t ON t.solve_id = s.solve_id"""
#: The same cells laid on a lattice of 48 a degree, eight tiles a row of them, and a window in each.
LATTICE = f"SELECT cast(44 * 48 + floor(tile / 8) * 48 + r as bigint) AS gr, cast(185 * 48 + tile % 8 * 48 + c as bigint) AS gc, elev FROM ({CELLS}) g"
CENTRES = """SELECT solve_id, 45.5 - floor(solve_id / 8) AS lat, 5.5 + solve_id % 8 AS lon, cast(20000 + solve_id % 4 * 9000 as double) AS radius_m FROM (""" + SOLVES + ") s"


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def tables(s, d):
    return [derive(s, d, x).repartition("solve_id") for x in (GRID, SOLVES, TARGETS)]


def bent(s, d):
    node = lambda r, c: F.struct(F.col(r).cast("long").alias("r"), F.col(c).cast("long").alias("c"))
    return derive(s, d, BENT).select("solve_id", "target_id", F.array(node("r0", "c0"), node("rm", "cm"), node("r", "c")).alias("nodes"))


def scores(s, d):
    grid, solves, targets = tables(s, d)
    found = rt.score_paths(bent(s, d), grid, solves, targets)
    return found.select("solve_id", "target_id", F.round("ratio", 3).alias("ratio"), F.round("length_m").cast("long").alias("length_m"), F.col("critical.r").alias("r"), F.col("critical.c").alias("c"))


def windows(s, d):
    return rt.routing_windows(derive(s, d, CENTRES), 48)


def lattice_grid(s, d):
    return rt.routing_grid(derive(s, d, LATTICE), windows(s, d), 48).select("solve_id", "r", "c", F.col("elev").cast("long").alias("elev"))


def reached(s, d):
    grid, solves, targets = tables(s, d)
    got = rt.reachability(grid, solves, targets)
    return got.select("solve_id", "target_id", "rung", F.round("length_m").cast("long").alias("length_m"), F.size("nodes").alias("cells"))


def routes(s, d):
    grid, solves, targets = tables(s, d)
    routed = rt.refine_paths(rt.reachability(grid, solves, targets), grid, solves, targets)
    lines = rt.score_paths(rt.direct_lines(solves, targets), grid, solves, targets)
    frame = solves.select("solve_id", F.lit(46.0).alias("north"), F.lit(5.0).alias("west"), F.lit(1 / 400).alias("lat_step"), F.lit(1 / 300).alias("lon_step"))
    return rt.describe_routes(rt.choose_routes(routed, lines), frame)


def profiles(s, d):
    grid, solves, _ = tables(s, d)
    got = rt.profiles(bent(s, d), grid, solves, 24)
    return got.select("solve_id", "target_id", F.round("length_m").cast("long").alias("length_m"), F.array_max("terrain").alias("top"), F.array_join("terrain", ",", "-").alias("terrain"))


WINDOWS = f"""b AS (SELECT *, greatest(0.2, cos(radians(lat))) AS shrink, radius_m / 111320.0 AS pad FROM ({plain(CENTRES)}) x),
k AS (SELECT *, greatest(1, cast(floor(3 / shrink + 0.5) as bigint)) AS k FROM b),
w AS (SELECT solve_id, k, cast(floor(floor((90 - lat - pad) * 48) / 3) * 3 as bigint) AS row0, cast(ceil((floor((90 - lat + pad) * 48) + 1) / 3) * 3 as bigint) AS row1,
  cast(floor(floor((lon - pad / shrink + 180) * 48) / k) * k as bigint) AS col0, cast(ceil((floor((lon + pad / shrink + 180) * 48) + 1) / k) * k as bigint) AS col1 FROM k)"""
GRID_SQL = f"""WITH l AS MATERIALIZED ({plain(LATTICE)}), {WINDOWS},
g AS (SELECT solve_id, cast(floor((gr - row0) / 3) as bigint) AS r, cast(floor((gc - col0) / k) as bigint) AS c, cast(max(elev) as bigint) AS elev
  FROM w JOIN l ON gr >= row0 AND gr < row1 AND gc >= col0 AND gc < col1 WHERE elev <> -32768 GROUP BY 1, 2, 3)"""
SCORE_SQL = f"""WITH cells AS MATERIALIZED ({plain(GRID)}), floors AS MATERIALIZED (SELECT solve_id, r, c, min(elev_m + 250.0) AS floor FROM ({plain(TARGETS)}) t GROUP BY 1, 2, 3),
p AS MATERIALIZED ({plain(BENT)}), legs AS (SELECT solve_id, target_id, alt_m, elev_m, 0 AS leg, r0 AS a, c0 AS b, rm AS y, cm AS x, 0.0 AS base,
    sqrt(pow((rm - r0) * north_m, 2) + pow((cm - c0) * east_m, 2)) AS len FROM p
  UNION ALL SELECT solve_id, target_id, alt_m, elev_m, 1, rm, cm, r, c, sqrt(pow((rm - r0) * north_m, 2) + pow((cm - c0) * east_m, 2)), sqrt(pow((r - rm) * north_m, 2) + pow((c - cm) * east_m, 2)) FROM p),
n AS (SELECT *, greatest(abs(y - a), abs(x - b)) AS n FROM legs), s AS (SELECT *, unnest(range(1, n + 1)) AS s FROM n WHERE n > 0),
t AS (SELECT *, cast(floor(a + (y - a) * s / n + 0.5) as bigint) AS r, cast(floor(b + (x - b) * s / n + 0.5) as bigint) AS c, base + len * s / n AS flown FROM s WHERE NOT (leg = 1 AND s = n)),
u AS (SELECT t.*, coalesce(alt_m - floor, CASE WHEN elev <> -32768 THEN alt_m - elev - 200.0 * least(1.0, flown / 2000.0) END) AS room
  FROM t LEFT JOIN cells USING (solve_id, r, c) LEFT JOIN floors USING (solve_id, r, c)),
v AS (SELECT *, CASE WHEN room > 0 THEN flown / room END AS need FROM u),
g AS (SELECT solve_id, target_id, count(*) <> count(need) AS blocked, max(need) AS worst FROM v GROUP BY 1, 2),
f AS (SELECT solve_id, target_id, r, c FROM (SELECT v.*, row_number() OVER (PARTITION BY solve_id, target_id ORDER BY need DESC NULLS LAST, leg, s) AS k FROM v) q WHERE k = 1),
e AS (SELECT solve_id, target_id, sum(len) AS length, any_value(alt_m - elev_m - 250.0) AS room FROM legs GROUP BY 1, 2),
z AS (SELECT solve_id, target_id, length, worst, CASE WHEN room > 0 AND NOT coalesce(blocked, false) THEN length / room END AS need, f.r, f.c FROM e LEFT JOIN g USING (solve_id, target_id) LEFT JOIN f USING (solve_id, target_id))"""

add("R3_routing_grid", lattice_grid, f"{GRID_SQL} SELECT solve_id, r, c, elev FROM g")
add(
    "R3_coverage",
    lambda s, d: rt.coverage(lattice_grid(s, d), windows(s, d)).select("solve_id", "covered", F.round("coverage", 6).alias("coverage")),
    f"{GRID_SQL} SELECT w.solve_id, count(g.r) AS covered, round(count(g.r) / any_value((row1 - row0) / 3 * (col1 - col0) / k), 6) AS coverage FROM w LEFT JOIN g USING (solve_id) GROUP BY 1",
)
add("R8_R9_reachability", reached)
add(
    "R10_score_paths",
    scores,
    f"{SCORE_SQL} SELECT solve_id, target_id, round(CASE WHEN need IS NOT NULL THEN greatest(need, coalesce(worst, 0.0)) END, 3) AS ratio, cast(round(length) as bigint) AS length_m, CASE WHEN need <= worst THEN r END AS r, CASE WHEN need <= worst THEN c END AS c FROM z",
)
add("R11_R12_R14_routes", routes)
add("R13_profiles", profiles)
