"""Registered queries over packs, snapshots, rasters, notes and tracks, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.operators import notes, packs, raster
from glidemesh.sources import fixtures as fx
from glidemesh.sources.fixtures import derive, plain
from glidemesh.streaming import throttle

QUERIES, ORACLES = {}, {}
C = F.col


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def members(s, d):
    return packs.assign_packs(derive(s, d, fx.SITES), derive(s, d, fx.PACKS), derive(s, d, fx.EDGES))


M = f"""WITH RECURSIVE sites AS ({plain(fx.SITES)}), packs AS ({fx.PACKS}), edges AS ({fx.EDGES}), media AS ({plain(fx.MEDIA)}),
members AS (SELECT src_seq, pack_id, pack_rank FROM sites JOIN packs USING (country)
  UNION ALL SELECT src_seq, pack_id, pack_rank FROM sites CROSS JOIN packs JOIN edges USING (fence)
  WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""
add("J9_assign_packs", members, f"{M} SELECT src_seq, pack_id, pack_rank FROM members")
#: Two packs on one ring that overlap between 7.3 and 9.2 degrees, and a pack by country.
BANDS = """SELECT 'west' AS pack_id, 1 AS pack_rank, cast(null as varchar(2)) AS country, cast(3 as int) AS fence, cast(null as double) AS min_lon, cast(9.2 as double) AS max_lon
  UNION ALL SELECT 'east', 2, NULL, 3, 7.3, NULL UNION ALL SELECT 'france', 3, 'FR', NULL, NULL, NULL UNION ALL SELECT 'north', 4, NULL, 1, 6.0, 11.0"""
add(
    "J9_banded_packs",
    lambda s, d: packs.assign_packs(derive(s, d, fx.SITES), derive(s, d, BANDS), derive(s, d, fx.EDGES)),
    f"""WITH sites AS ({plain(fx.SITES)}), packs AS ({BANDS}), edges AS ({fx.EDGES}) SELECT src_seq, pack_id, pack_rank FROM sites JOIN packs USING (country)
    UNION ALL SELECT src_seq, pack_id, pack_rank FROM sites CROSS JOIN packs JOIN edges USING (fence)
    WHERE (min_lon IS NULL OR lon >= min_lon) AND (max_lon IS NULL OR lon <= max_lon) AND (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    GROUP BY ALL HAVING count(*) % 2 = 1""",
)
add("W5_first_pack", lambda s, d: packs.first_pack(members(s, d)), f"{M} SELECT src_seq, arg_min(pack_id, pack_rank) AS pack_id FROM members GROUP BY src_seq")
FILES = ", files AS (SELECT pack_id, url, max(bytes) AS bytes, count(*) AS items FROM members JOIN media ON site = src_seq GROUP BY pack_id, url)"
add(
    "A11_pack_manifest",
    lambda s, d: packs.pack_manifest(members(s, d), derive(s, d, fx.MEDIA)),
    f"{M}{FILES} SELECT m.pack_id, count(DISTINCT src_seq) AS sites, coalesce(any_value(i), 0) AS media_items, coalesce(any_value(f), 0) AS files, coalesce(any_value(b), 0) AS bytes FROM members m LEFT JOIN (SELECT pack_id, cast(sum(items) as bigint) AS i, count(*) AS f, cast(sum(bytes) as bigint) AS b FROM files GROUP BY pack_id) t ON t.pack_id = m.pack_id GROUP BY m.pack_id",
)
add(
    "A13_selection_bytes",
    lambda s, d: packs.selection_bytes(members(s, d), derive(s, d, fx.MEDIA), ["north", "france"]),
    f"{M} SELECT count(*) AS files, cast(sum(bytes) as bigint) AS bytes FROM (SELECT url, max(bytes) AS bytes FROM (SELECT DISTINCT src_seq FROM members WHERE pack_id IN ('north', 'france')) x JOIN media ON site = src_seq GROUP BY url) y",
)
add(
    "A5_merge_media",
    lambda s, d: packs.merge_media(derive(s, d, fx.MEDIA)).select("site", F.md5(F.array_join("urls", ",")).alias("urls"), F.size("urls").cast("long").alias("n")),
    f"WITH media AS ({plain(fx.MEDIA)}), o AS (SELECT site, url, min(pos) AS pos FROM media GROUP BY site, url) SELECT site, md5(string_agg(cast(url as varchar), ',' ORDER BY pos, url)) AS urls, count(*) AS n FROM o GROUP BY site",
)
add(
    "W6_select_documents",
    lambda s, d: packs.select_documents(derive(s, d, fx.EDITIONS), "en"),
    f"SELECT seq, code, slot, lang FROM (SELECT *, row_number() OVER (PARTITION BY code, slot ORDER BY CASE WHEN lang <> 'en' THEN 1 ELSE 0 END, seq) AS r FROM ({plain(fx.EDITIONS)}) e) x WHERE r = 1",
)
add(
    "W7_prefer_source",
    lambda s, d: packs.prefer_source(derive(s, d, fx.EDITIONS).where("lang = 'fr'"), derive(s, d, fx.EDITIONS).where("lang <> 'fr' and seq % 3 = 0"), "code").select("seq", "code", "origin"),
    f"WITH e AS ({plain(fx.EDITIONS)}) SELECT seq, code, 'primary' AS origin FROM e WHERE lang = 'fr' UNION ALL SELECT seq, code, 'secondary' FROM e WHERE lang <> 'fr' AND seq % 3 = 0 AND code NOT IN (SELECT code FROM e WHERE lang = 'fr')",
)
add(
    "W8_pick_effective",
    lambda s, d: packs.pick_effective(derive(s, d, "SELECT o_custkey % 5 AS publisher, cast(o_orderdate as date) AS day FROM {orders}"), "publisher", "day", "1995-06-17"),
    "SELECT o_custkey % 5 AS publisher, coalesce(max(cast(o_orderdate as date)) FILTER (cast(o_orderdate as date) <= date '1995-06-17'), min(cast(o_orderdate as date)) FILTER (cast(o_orderdate as date) > date '1995-06-17')) AS effective FROM orders GROUP BY 1",
)
SNAP = f"WITH l AS ({plain(fx.LOCAL)}), r AS ({plain(fx.REMOTE)})"
add(
    "J14_diff_snapshots",
    lambda s, d: packs.diff_snapshots(derive(s, d, fx.LOCAL), derive(s, d, fx.REMOTE)),
    f"{SNAP} SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.hash IS NULL THEN 'new' WHEN l.hash IS NULL THEN 'stale' WHEN l.hash = r.hash THEN 'unchanged' ELSE 'changed' END AS status FROM l FULL JOIN r ON l.path = r.path",
)
add(
    "J15_sync_plan",
    lambda s, d: packs.diff_snapshots(derive(s, d, fx.LOCAL), derive(s, d, fx.REMOTE)).select("path", F.when(C("status").isin("new", "changed"), "fetch").when(C("status") == "stale", "evict").otherwise("keep").alias("action")).groupBy("action").agg(F.count("*").alias("n"), F.min("path").alias("first")),
    f"{SNAP} SELECT CASE WHEN r.hash IS NULL OR l.hash <> r.hash THEN 'fetch' WHEN l.hash IS NULL THEN 'evict' ELSE 'keep' END AS action, count(*) AS n, min(coalesce(l.path, r.path)) AS first FROM l FULL JOIN r ON l.path = r.path GROUP BY 1",
)
add(
    "W9_W10_merge_index",
    lambda s, d: packs.prefer_source(derive(s, d, fx.LOCAL), derive(s, d, fx.REMOTE), "path").select("path", "origin"),
    f"{SNAP} SELECT path, 'primary' AS origin FROM l UNION ALL SELECT path, 'secondary' FROM r WHERE path NOT IN (SELECT path FROM l)",
)
add(
    "A14_fingerprint",
    lambda s, d: packs.fingerprint(derive(s, d, fx.LOCAL).withColumn("dir", C("path") % 16), "dir"),
    f"{SNAP} SELECT path % 16 AS dir, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (SELECT path, cast(path as varchar) || ':' || substr(hash, 1, 12) AS line FROM l) x GROUP BY 1",
)
add(
    "A18_coverage_status",
    lambda s, d: packs.coverage_status(derive(s, d, fx.LOCAL).withColumn("dir", C("path") % 16), derive(s, d, fx.REMOTE), "dir"),
    f"{SNAP} SELECT l.path % 16 AS dir, count(*) AS expected, count(x.path) AS held, CASE WHEN count(*) = count(x.path) THEN 'ready' WHEN count(x.path) > 0 THEN 'incomplete' ELSE 'not-downloaded' END AS status FROM l LEFT JOIN (SELECT DISTINCT path FROM r) x ON x.path = l.path GROUP BY 1",
)

# -- rasters

CELLS = f"WITH cells AS ({plain(fx.CELLS)})"
add(
    "R2_pool_max",
    lambda s, d: raster.pool_max(derive(s, d, fx.CELLS), 3, 4),
    f"{CELLS} SELECT tile, cast(floor(r / 3) as bigint) AS r, cast(floor(c / 4) as bigint) AS c, cast(coalesce(max(CASE WHEN elev <> -32768 THEN elev END), -32768) as bigint) AS elev FROM cells GROUP BY 1, 2, 3",
)
add(
    "R4_gradient",
    lambda s, d: raster.raster_gradient(derive(s, d, fx.CELLS)),
    f"""{CELLS}, m AS MATERIALIZED (SELECT tile, r, c, elev FROM cells), a AS (SELECT *, elev - coalesce(lag(elev) OVER (PARTITION BY tile, r ORDER BY c), 0) AS h FROM m)
    SELECT tile, r, c, cast(((h - coalesce(lag(h) OVER (PARTITION BY tile, c ORDER BY r), 0)) % 65536 + 65536) % 65536 as bigint) AS g FROM a""",
)
add(
    "R4_integrate",
    lambda s, d: raster.raster_integrate(raster.raster_gradient(derive(s, d, fx.CELLS))),
    f"{CELLS} SELECT tile, r, c, cast(elev as bigint) AS elev FROM cells",
)
add(
    "R5_tile_index",
    lambda s, d: raster.tile_index(derive(s, d, fx.CELLS)),
    f"{CELLS} SELECT tile, count(*) AS cells, count(CASE WHEN elev <> -32768 THEN 1 END) AS known, cast(max(CASE WHEN elev <> -32768 THEN elev END) as bigint) AS highest FROM cells GROUP BY tile",
)
LINES = "SELECT s_suppkey AS pair, cast(0 as bigint) AS tile, 30 + s_suppkey % 18 AS r0, s_suppkey * 7 % 48 AS c0, s_suppkey * 5 % 16 AS r1, s_suppkey * 11 % 48 AS c1, CASE WHEN s_suppkey % 2 = 0 THEN cast(1200 as double) ELSE cast(3500 as double) END AS alt FROM {supplier}"
DIRECT = f"""{CELLS}, l AS ({plain(LINES)}), n AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n FROM l),
w AS (SELECT *, cast(floor(r0 + (r1 - r0) * s / n + 0.5) as bigint) AS r, cast(floor(c0 + (c1 - c0) * s / n + 0.5) as bigint) AS c,
  sqrt(pow(r1 - r0, 2) + pow(c1 - c0, 2)) * 278.0 * s / n AS flown FROM (SELECT *, unnest(range(1, n + 1)) AS s FROM n) u),
t AS (SELECT pair, s, n, flown, CASE WHEN elev = -32768 THEN NULL WHEN s = n THEN alt - elev - 250.0 ELSE alt - elev - 200.0 * least(1.0, flown / 2000.0) END AS room FROM w JOIN cells USING (tile, r, c)),
q AS (SELECT *, CASE WHEN room > 0 THEN flown / room END AS ratio FROM t)"""
add(
    "R6_walk_lines",
    lambda s, d: raster.walk_lines(derive(s, d, LINES)).select("pair", C("s").cast("long").alias("s"), "r", "c"),
    f"{DIRECT} SELECT pair, s, r, c FROM w",
)
add(
    "R7_direct_score",
    lambda s, d: raster.direct_score(derive(s, d, LINES), derive(s, d, fx.CELLS)),
    f"""{DIRECT} SELECT pair, CASE WHEN count(*) = count(ratio) THEN round(max(ratio), 3) END AS ratio,
    (SELECT s FROM q b WHERE b.pair = q.pair ORDER BY coalesce(ratio, 1e18) DESC, s LIMIT 1) AS critical FROM q GROUP BY pair""",
)

# -- notes


def even_conversations(s, d):
    """Every second conversation, as the SQL of the two queries has it; ``notes_all`` takes them all."""
    return derive(s, d, "SELECT conv_id, text FROM {conversations} WHERE conv_id % 2 = 0")


add(
    "T1_segment_notes",
    lambda s, d: notes.segments(derive(s, d, notes.NOTES)),
    f"WITH s AS ({notes.SEGMENTS_SQL.format(notes=plain(notes.NOTES))}) SELECT * FROM s",
)
add(
    "T2_T5_memory_lookup",
    lambda s, d: notes.apply_memory(derive(s, d, notes.NOTES), notes.memory(even_conversations(s, d))).groupBy("state").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    f"""WITH s AS ({notes.SEGMENTS_SQL.format(notes=plain(notes.NOTES))}), m AS (SELECT DISTINCT trim(line) AS norm FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations WHERE conv_id % 2 = 0) x WHERE trim(line) <> '')
    SELECT CASE WHEN s.value = '' THEN 'blank' WHEN m.norm IS NULL THEN 'fallback' ELSE 'cached' END AS state, count(*) AS n, cast(sum(length(s.value)) as bigint) AS chars FROM s LEFT JOIN m ON m.norm = s.value GROUP BY 1""",
)
add(
    "T3_misses_in_budget",
    lambda s, d: notes.misses(derive(s, d, notes.NOTES), notes.memory(even_conversations(s, d)), 300_000),
    f"""WITH s AS ({notes.SEGMENTS_SQL.format(notes=plain(notes.NOTES))}), m AS (SELECT DISTINCT trim(line) AS norm FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations WHERE conv_id % 2 = 0) x),
    f AS (SELECT value, min(note_id * 100000 + pos) AS first FROM s WHERE value <> '' AND value NOT IN (SELECT norm FROM m) GROUP BY value)
    SELECT first, chars, cast(total as bigint) AS total FROM (SELECT first, length(value) AS chars, sum(length(value)) OVER (ORDER BY first) AS total FROM f) x WHERE total <= 300000""",
)

# -- streams

TRACK = f"WITH RECURSIVE t AS ({plain(fx.TRACK)})"
add(
    "X1_throttle",
    lambda s, d: throttle.throttle_batch(derive(s, d, fx.TRACK)),
    f"""{TRACK}, w AS (SELECT session_id, event_id, n, lat, lon, alt_m, lat AS ql, lon AS qo, alt_m AS qa, true AS go FROM t WHERE n = 1
    UNION ALL SELECT x.session_id, x.event_id, x.n, x.lat, x.lon, x.alt_m, CASE WHEN x.g THEN x.lat ELSE x.ql END, CASE WHEN x.g THEN x.lon ELSE x.qo END, CASE WHEN x.g THEN x.alt_m ELSE x.qa END, x.g
    FROM (SELECT t.*, w.ql, w.qo, w.qa, abs(t.alt_m - w.qa) >= 75 OR 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(t.lat) - radians(w.ql)) / 2), 2) + cos(radians(w.ql)) * cos(radians(t.lat)) * pow(sin((radians(t.lon) - radians(w.qo)) / 2), 2)))) >= 400 AS g
      FROM w JOIN t ON t.session_id = w.session_id AND t.n = w.n + 1) x)
    SELECT session_id, event_id, n FROM w WHERE go""",
)
add(
    "X3_latest_per_session",
    lambda s, d: throttle.latest_per_session(derive(s, d, fx.TRACK)),
    f"{TRACK} SELECT session_id, max(event_id) AS event_id FROM t GROUP BY session_id",
)
