"""SQL twins of choice, description and profiles of routes over bent paths and straight lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.operators import routing as rt
from glidemesh.plans.routing import BENT, GRID, SCORE_SQL, bent, tables
from glidemesh.sources.fixtures import plain

#: Straight lines as paths that bend where they begin.
STRAIGHT = BENT.replace("t.target_id % 19 + 25 AS rm, t.target_id * 3 % 48 AS cm", "s.r0 AS rm, s.c0 AS cm")
ROW = """SELECT z.solve_id, z.target_id, CASE WHEN need IS NOT NULL THEN greatest(need, coalesce(worst, 0.0)) END AS ratio, length, CASE WHEN need <= worst THEN r END AS r, CASE WHEN need <= worst THEN c END AS c FROM z"""


def scored(paths: str) -> str:
    return f"({SCORE_SQL.replace(plain(BENT), plain(paths))} {ROW})"


def chosen(s, d):
    grid, solves, targets = tables(s, d)
    routed = rt.score_paths(bent(s, d), grid, solves, targets)
    lines = rt.score_paths(rt.direct_lines(solves, targets), grid, solves, targets)
    frame = solves.select("solve_id", F.lit(46.0).alias("north"), F.lit(5.0).alias("west"), F.lit(1 / 400).alias("lat_step"), F.lit(1 / 300).alias("lon_step"))
    got = rt.describe_routes(rt.choose_routes(routed, lines), frame)
    return got.select(
        "solve_id", "target_id", "direct", F.round("ratio", 3).alias("ratio"), F.round("length_m").cast("long").alias("length_m"), F.round("direct_ratio", 3).alias("direct_ratio"),
        F.round("direct_m").cast("long").alias("direct_m"), "legs", F.round("critical_lat", 5).alias("critical_lat"), F.round("critical_lon", 5).alias("critical_lon"),
    )


CHOSEN = f"""WITH a AS (SELECT * FROM {scored(BENT)} x WHERE ratio IS NOT NULL), b AS (SELECT * FROM {scored(STRAIGHT)} y WHERE ratio IS NOT NULL),
j AS (SELECT coalesce(a.solve_id, b.solve_id) AS solve_id, coalesce(a.target_id, b.target_id) AS target_id, coalesce(b.ratio <= a.ratio, a.ratio IS NULL) AS direct, a.ratio AS ar, a.length AS al, a.r AS rr, a.c AS rc, b.ratio AS br, b.length AS bl, b.r AS lr, b.c AS lc
  FROM a FULL JOIN b ON a.solve_id = b.solve_id AND a.target_id = b.target_id)
SELECT solve_id, target_id, direct, round(CASE WHEN direct THEN br ELSE ar END, 3) AS ratio, cast(round(CASE WHEN direct THEN bl ELSE al END) as bigint) AS length_m, round(br, 3) AS direct_ratio,
  cast(round(bl) as bigint) AS direct_m, CASE WHEN direct THEN 1 ELSE 2 END AS legs, round(46.0 - (CASE WHEN direct THEN lr ELSE rr END + 0.5) / 400.0, 5) AS critical_lat, round(5.0 + (CASE WHEN direct THEN lc ELSE rc END + 0.5) / 300.0, 5) AS critical_lon FROM j"""

BINS = 24
PROFILES = f"""WITH cells AS MATERIALIZED ({plain(GRID)}), p AS MATERIALIZED ({plain(BENT)}),
legs AS (SELECT solve_id, target_id, 0 AS leg, r0 AS a, c0 AS b, rm AS y, cm AS x, 0.0::DOUBLE AS base, sqrt(pow((rm - r0) * north_m, 2) + pow((cm - c0) * east_m, 2)) AS len FROM p
  UNION ALL SELECT solve_id, target_id, 1, rm, cm, r, c, sqrt(pow((rm - r0) * north_m, 2) + pow((cm - c0) * east_m, 2)), sqrt(pow((r - rm) * north_m, 2) + pow((c - cm) * east_m, 2)) FROM p),
n AS (SELECT *, greatest(abs(y - a), abs(x - b)) AS n FROM legs), s AS (SELECT *, unnest(range(1, n + 1)) AS s FROM n WHERE n > 0),
t AS (SELECT solve_id, target_id, leg, s, cast(floor(a + (y - a) * s / n + 0.5) as bigint) AS r, cast(floor(b + (x - b) * s / n + 0.5) as bigint) AS c, base + len * s / n AS flown FROM s
  UNION ALL SELECT solve_id, target_id, -1, 0, r0, c0, 0.0 FROM p),
u AS MATERIALIZED (SELECT t.solve_id, t.target_id, flown, CASE WHEN elev <> -32768 THEN elev END AS elev, row_number() OVER (PARTITION BY t.solve_id, t.target_id ORDER BY leg, s) AS k FROM t LEFT JOIN cells USING (solve_id, r, c)),
l AS (SELECT solve_id, target_id, arg_max(flown, k) AS length, arg_max(flown, k) / {BINS - 1} AS step FROM u GROUP BY 1, 2 HAVING count(*) > 1),
b AS (SELECT *, i * step AS want FROM (SELECT *, unnest(range(0, {BINS})) AS i FROM l) x),
f AS (SELECT b.solve_id, b.target_id, i, any_value(want) AS want, any_value(step) AS step, any_value(length) AS length, greatest(count(*) FILTER (flown < want), 1) AS first FROM b JOIN u USING (solve_id, target_id) GROUP BY 1, 2, 3),
h AS (SELECT f.solve_id, f.target_id, i, any_value(length) AS length, max(elev) FILTER (k = first OR flown <= want + step) AS top FROM f JOIN u ON u.solve_id = f.solve_id AND u.target_id = f.target_id AND k >= first GROUP BY 1, 2, 3)
SELECT solve_id, target_id, cast(round(any_value(length)) as bigint) AS length_m, max(top) AS top, string_agg(coalesce(cast(top as varchar), '-'), ',' ORDER BY i) AS terrain FROM h GROUP BY 1, 2"""

QUERIES = {"R12_R14_choose_describe": chosen}
ORACLES = {"R12_R14_choose_describe": CHOSEN, "R13_profiles": PROFILES}
