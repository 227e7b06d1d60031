"""Registered queries over contributions, searches, versions and gates, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.operators import matching, resolve
from glidemesh.plans.sites import NEAR, S, hav, sites
from glidemesh.sources import fixtures as fx
from glidemesh.sources.fixtures import derive, plain

QUERIES, ORACLES = {}, {}
C = F.col


def add(name, fn, sql):
    QUERIES[name], ORACLES[name] = fn, sql


add(
    "F8_norm_country",
    lambda s, d: derive(s, d, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Suisse' WHEN 1 THEN ' de' WHEN 2 THEN 'Spain' ELSE 'IT' END AS raw FROM {part}").select("p_partkey", text.norm_country(C("raw")).alias("country")),
    "SELECT p_partkey, (['CH', 'DE', 'ES', 'IT'])[p_partkey % 4 + 1] AS country FROM part",
)
add(
    "F12_parse_float",
    lambda s, d: derive(s, d, """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE '"' || p_partkey || ',5 "' END AS raw FROM {part}""").select("p_partkey", text.parse_float(text.clean(C("raw"))).alias("value")),
    "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey + cast(0.5 as double) END AS value FROM part",
)
add(
    "F16_display_code",
    lambda s, d: sites(s, d).select("site_id", text.display_code(F.when(C("src_seq") % 2 == 0, F.concat("code", F.lit("_45P5_M7P25"))).otherwise(C("code"))).alias("code")),
    f"{S} SELECT site_id, CASE WHEN src_seq % 2 = 0 THEN '' ELSE code END AS code FROM sites",
)
add(
    "F25_note_for",
    lambda s, d: derive(s, d, "SELECT doc_id, lang, text FROM {documents}").select("doc_id", F.create_map("lang", "text").alias("n")).select("doc_id", F.md5(matching.note_for(C("n"), "es")).alias("digest")),
    "SELECT doc_id, CASE WHEN lang IN ('es', 'en', 'fr', 'de') THEN md5(nullif(text, '')) END AS digest FROM documents",
)
add(
    "F31_media_refs",
    lambda s, d: derive(s, d, "SELECT p_partkey, 'pics/a' || p_partkey || '.JPG;note.txt, docs/vac/b' || p_size || '.pdf' AS raw FROM {part}").select("p_partkey", F.array_join(text.media_refs(C("raw")), " ").alias("files")),
    "SELECT p_partkey, 'a' || p_partkey || '.JPG b' || p_size || '.pdf' AS files FROM part",
)
add(
    "F35_extract_codes",
    lambda s, d: sites(s, d).select("site_id", F.array_join(text.extract_codes(F.concat(F.lit("see "), F.lower("code"), F.lit(" and LFMM, lfmm"))), ",").alias("codes")),
    f"{S} SELECT site_id, CASE WHEN code IN ('', 'LFMM') THEN 'LFMM' WHEN code < 'LFMM' THEN code || ',LFMM' ELSE 'LFMM,' || code END AS codes FROM sites",
)
add(
    "J7_name_cols",
    lambda s, d: resolve.nearest_within(derive(s, d, fx.FIXES), sites(s, d), 1500.0, "fix_id", strict=True, first=True).select("fix_id", C("site.name").alias("col_name")),
    f"{NEAR} SELECT fix_id, name AS col_name FROM (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY d, src_seq) AS r FROM k WHERE d < 1500) x JOIN sites USING (src_seq) WHERE r = 1",
)
CONTRIBS = """SELECT event_id AS contrib_id, CASE WHEN event_id % 3 = 0 THEN 'a' || cast(event_id as varchar(20)) ELSE '' END AS want_id,
  CASE WHEN event_id % 3 = 1 THEN 'LF' || chr(cast(65 + event_id % 26 as int)) || chr(cast(65 + event_id % 25 as int)) ELSE '' END AS want_code,
  (43000 + event_id * 613 % 4000) / cast(1000 as double) AS lat, (5000 + event_id * 811 % 7000) / cast(1000 as double) AS lon FROM {events}"""
add(
    "J8_resolve_contributions",
    lambda s, d: matching.resolve_contributions(derive(s, d, CONTRIBS), sites(s, d), 3000.0),
    f"""{S}, c AS ({plain(CONTRIBS)}), u AS (SELECT code, min(src_seq) AS seq FROM sites WHERE code <> '' GROUP BY code HAVING count(*) = 1),
    j AS (SELECT c.*, s.src_seq AS by_id, u.seq AS by_code FROM c LEFT JOIN sites s ON s.site_id = want_id LEFT JOIN u ON u.code = want_code),
    p AS (SELECT contrib_id, arg_min(seq, (d, -seq)) AS by_place FROM (SELECT contrib_id, s.src_seq AS seq, {hav('j.lat', 'j.lon', 's.lat', 's.lon')} AS d FROM j JOIN sites s ON s.lat BETWEEN j.lat - 0.03 AND j.lat + 0.03 AND s.lon BETWEEN j.lon - 0.05 AND j.lon + 0.05 WHERE by_id IS NULL AND by_code IS NULL) x WHERE d <= 3000 GROUP BY contrib_id)
    SELECT contrib_id, coalesce(by_id, by_code, by_place) AS src_seq, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_code IS NOT NULL THEN 'code' WHEN by_place IS NOT NULL THEN 'place' END AS how FROM j LEFT JOIN p USING (contrib_id)""",
)
POINTS = "SELECT o_orderkey AS point, o_orderkey % 10 * 100 AS tile, o_custkey % 50 AS r, o_orderkey % 48 AS c FROM {orders}"
add(
    "J13_sample_cells",
    lambda s, d: matching.sample_cells(derive(s, d, POINTS), derive(s, d, fx.CELLS)).select("point", "elev"),
    f"WITH p AS ({plain(POINTS)}), cells AS ({plain(fx.CELLS)}) SELECT point, cast(nullif(elev, -32768) as bigint) AS elev FROM p LEFT JOIN cells USING (tile, r, c)",
)
SNAP = f"WITH l AS ({plain(fx.LOCAL)}), r AS ({plain(fx.REMOTE)})"
add(
    "J17_version_drift",
    lambda s, d: matching.version_drift(derive(s, d, fx.LOCAL), derive(s, d, fx.REMOTE)),
    f"{SNAP} SELECT path, coalesce(l.hash <> r.hash, false) AS drift FROM l LEFT JOIN r USING (path)",
)


def in_dirs(s, d):
    return [derive(s, d, q).withColumn("dir", F.pmod("path", F.lit(97))) for q in (fx.LOCAL, fx.REMOTE)]


add(
    "A15_states_match",
    lambda s, d: matching.states_match(*in_dirs(s, d), "dir"),
    f"{SNAP} SELECT (coalesce(l.path, r.path) % 97 + 97) % 97 AS dir, bool_and(coalesce(l.hash, '') = coalesce(r.hash, '')) AS same FROM l FULL JOIN r ON l.path = r.path GROUP BY 1",
)
add(
    "A20_selection_census",
    lambda s, d: matching.selection_census(derive(s, d, fx.EDITIONS), "^(en|fr)$"),
    f"SELECT code, count(*) FILTER (lang NOT IN ('en', 'fr')) AS kept, count(*) FILTER (lang IN ('en', 'fr')) AS skipped FROM ({plain(fx.EDITIONS)}) e GROUP BY code",
)
add(
    "D2_gate",
    lambda s, d: matching.gate(*in_dirs(s, d), "dir", 0.8),
    f"{SNAP}, e AS (SELECT path % 97 AS dir, count(*) AS expected FROM l GROUP BY 1), g AS (SELECT (path % 97 + 97) % 97 AS dir, count(*) AS got FROM r GROUP BY 1) SELECT dir, expected, coalesce(got, 0) AS got, coalesce(got, 0) > 0 AND coalesce(got, 0) >= expected * cast(0.8 as double) AS passes FROM e LEFT JOIN g USING (dir)",
)
add(
    "P4_search_sites",
    lambda s, d: matching.search_sites(sites(s, d), "Cust  1").select("site_id", "name"),
    f"{S} SELECT site_id, name FROM sites WHERE contains(lower(name || ' ' || code), 'cust') AND contains(lower(name || ' ' || code), '1') ORDER BY name, src_seq LIMIT 80",
)
