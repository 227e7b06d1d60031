"""Registered queries over raw records, notes, versions and routes, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.functions import geo, records
from glidemesh.operators import records as ops
from glidemesh.plans.sites import S, hav, sites
from glidemesh.sources import fixtures as fx
from glidemesh.sources.fixtures import derive, plain

QUERIES, ORACLES = {}, {}
C = F.col


def add(name, fn, sql):
    QUERIES[name], ORACLES[name] = fn, sql


V = lambda e: f"cast({e} as varchar(20))"
LA, LO, T, E = V("p_partkey % 80") + " || '.5'", V("p_partkey % 170") + " || '.25'", V("p_partkey % 16"), V("p_size")
RECORDS = f"""SELECT p_partkey AS k, CASE p_partkey % 4
  WHEN 0 THEN '{{{{"geometry":{{{{"coordinates":[' || {LO} || ',' || {LA} || ']}}}},"type":' || {T} || ',"elevation":{{{{"value":' || {E} || ',"unit":"FT"}}}}}}}}'
  WHEN 1 THEN '{{{{"lat":"' || {LA} || '","lng":"' || {LO} || '","type":"' || {T} || '","elevation":' || {E} || '}}}}'
  WHEN 2 THEN '{{{{"properties":{{{{"location":{{{{"latitude":' || {LA} || ',"longitude":' || {LO} || '}}}}}}}},"type":{{{{"name":"Strip"}}}},"elevation":{{{{"value":' || {E} || ',"uom":"m"}}}}}}}}'
  ELSE '{{{{"position":{{{{"lat":' || {LA} || ',"lng":' || {LO} || '}}}},"note":"Segelflug"}}}}' END AS raw FROM {{part}}"""


def raws(s, d):
    return derive(s, d, RECORDS)


add(
    "F4_normalize_metres",
    lambda s, d: raws(s, d).select("k", records.normalize_metres(records.first_path("raw", "elevation")).alias("metres")),
    "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN round_even(p_size * cast(0.3048 as double), 1) WHEN 3 THEN NULL ELSE cast(p_size as double) END AS metres FROM part",
)
add(
    "F7_F9_extract_point",
    lambda s, d: raws(s, d).select("k", records.extract_point(C("raw")).alias("p")).select("k", "p.lat", "p.lon"),
    "SELECT p_partkey AS k, p_partkey % 80 + cast(0.5 as double) AS lat, p_partkey % 170 + cast(0.25 as double) AS lon FROM part",
)
NAMES = "['" + "','".join([*records.AIRPORT_TYPES.values(), "14", "15"]) + "']"
add(
    "F10_type_name",
    lambda s, d: raws(s, d).select("k", records.type_name(records.first_path("raw", "type")).alias("type"), records.freq_type_name((C("k") % 9).cast("string")).alias("freq")),
    f"SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 2 THEN 'Strip' WHEN 3 THEN '' ELSE ({NAMES})[p_partkey % 16 + 1] END AS type, (['OTHER','A/A','AFIS','TWR','APP','ATIS','GND','INFO',''])[p_partkey % 9 + 1] AS freq FROM part",
)
add(
    "P1_filter_relevant",
    lambda s, d: raws(s, d).where(records.is_relevant(C("raw"), [1, 12])).select("k"),
    "SELECT p_partkey AS k FROM part WHERE p_partkey % 4 = 3 OR (p_partkey % 4 < 2 AND p_partkey % 16 IN (1, 12))",
)
SLUG = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
add(
    "F15_stable_id",
    lambda s, d: sites(s, d).select("site_id", records.stable_id(C("country"), C("code"), C("name"), C("lat"), -C("lon")).alias("id"), records.mint_code(C("country"), C("name"), C("lat"), -C("lon")).alias("minted")),
    f"""{S} SELECT site_id, lower(country) || '_' || CASE WHEN length(code) BETWEEN 3 AND 5 THEN lower(code) || '_' ELSE '' END || {SLUG} || '_' || replace(printf('%.4f', lat), '.', 'p') || '_m' || replace(printf('%.4f', lon), '.', 'p') AS id,
    country || '_' || upper(substr({SLUG}, 1, 24)) || '_' || replace(printf('%.3f', lat), '.', 'P') || '_M' || replace(printf('%.3f', lon), '.', 'P') AS minted FROM sites""",
)
NOTE = """SELECT p_partkey AS k, 'First line.' || chr(10) || CASE p_partkey % 3 WHEN 0 THEN ' surface : wet  grass; soft' WHEN 1 THEN 'Richtung: 07/25' ELSE 'none' END || chr(10) || 'end' AS notes,
  cast(p_size * 10 as double) AS len, cast(p_partkey % 36 * 10 as double) AS hdg, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'UNKNOWN' END AS grade FROM {part}"""
add(
    "F22_F26_cup_description",
    lambda s, d: derive(s, d, NOTE).select("k", records.cup_description(C("grade"), C("notes"), C("hdg"), C("len"), F.when(C("k") % 5 == 0, 20.0), F.when(C("k") % 7 == 0, "123.500")).alias("text")),
    f"""SELECT k, concat_ws(' · ', CASE WHEN grade = 'A' THEN '[A]' END, CASE WHEN k % 3 = 1 THEN '07/25' ELSE lpad(cast(cast(hdg as bigint) as varchar), 3, '0') || '°' END,
    cast(cast(len as bigint) as varchar) || CASE WHEN k % 5 = 0 THEN '×20 m' ELSE ' m' END, CASE WHEN k % 3 = 0 THEN 'wet grass' END, CASE WHEN k % 7 = 0 THEN '123.500 MHz' END) AS text FROM ({plain(NOTE)}) n""",
)
add(
    "F30_note_source_lang",
    lambda s, d: sites(s, d).select("site_id", records.note_source_lang(F.when(C("src_seq") % 7 != 0, C("source"))).alias("lang")),
    f"{S} SELECT site_id, CASE WHEN src_seq % 7 = 0 THEN NULL WHEN source = 'guide' THEN 'fr' ELSE 'en' END AS lang FROM sites",
)


def cycle_dates(s, d):
    day = F.date_add(F.to_date("o_orderdate"), 3650)
    raw = F.when(C("k") % 3 == 0, F.date_format(day, "yyMMdd")).when(C("k") % 3 == 1, F.concat(F.lit("https://x/"), F.upper(F.date_format(day, "yyyyMMMdd")), F.lit("/c.html"))).otherwise(F.concat(F.lit("(A07-26)_"), F.date_format(day, "yyyy_MM_dd")))
    return derive(s, d, "SELECT o_orderkey AS k, o_orderdate FROM {orders}").select("k", records.parse_cycle_date(raw).alias("day"))


add("F33_parse_cycle_date", cycle_dates, "SELECT o_orderkey AS k, cast(cast(o_orderdate as date) + 3650 as date) AS day FROM orders")
add(
    "G7_route_heights",
    lambda s, d: sites(s, d).select("site_id", F.round(geo.arrival_height(F.lit(3000.0), C("length_m") * 10, F.lit(20.0), C("elev_m")), 3).alias("arrival"), F.round(records.crossing_clearance(F.lit(1500.0), C("elev_m"), C("length_m") * 10, F.lit(20.0)), 3).alias("clears"), records.is_detour(C("length_m"), F.lit(1000.0), C("kind") == "airfield").alias("detour")),
    f"{S} SELECT site_id, round(3000 - length_m * 10 / 20 - elev_m, 3) AS arrival, CASE WHEN elev_m < 1500 AND 1500 - elev_m - length_m * 10 / 20 > 0 THEN round(1500 - elev_m - length_m * 10 / 20, 3) END AS clears, kind <> 'airfield' AND length_m > 1100 AS detour FROM sites",
)
add(
    "J1_enrich_freqs",
    lambda s, d: ops.enrich_freqs(sites(s, d), derive(s, d, fx.FREQS).join(derive(s, d, fx.AIRPORTS).select(C("src_seq").alias("airport"), F.lower("code").alias("code")), "airport")).select("site_id", F.array_join(F.transform("mhz", lambda x: F.format_string("%.3f", x)), ",").alias("mhz")),
    f"""{S}, a AS ({plain(fx.AIRPORTS)}), f AS ({plain(fx.FREQS)}), u AS (SELECT DISTINCT code, printf('%.3f', mhz) AS mhz FROM f JOIN a ON a.src_seq = f.airport WHERE code <> ''),
    g AS (SELECT code, string_agg(mhz, ',' ORDER BY mhz) AS mhz FROM u GROUP BY code) SELECT site_id, coalesce(mhz, '') AS mhz FROM sites LEFT JOIN g USING (code)""",
)
DOCS = "SELECT DISTINCT 'LF' || chr(cast(65 + doc_id % 26 as int)) || chr(cast(65 + doc_id % 25 as int)) AS code, 'docs/vac/' || cast(doc_id % 26 as varchar(9)) || '.pdf' AS doc FROM {documents}"
add(
    "J11_attach_documents",
    lambda s, d: ops.attach_documents(sites(s, d).withColumn("doc", F.when(C("src_seq") % 2 == 0, "own.pdf")), derive(s, d, DOCS)).select("site_id", "doc"),
    f"{S}, d AS (SELECT code, min(doc) AS doc FROM ({plain(DOCS)}) x GROUP BY code) SELECT site_id, CASE WHEN src_seq % 2 = 0 THEN 'own.pdf' ELSE doc END AS doc FROM sites LEFT JOIN d USING (code)",
)
ANS = "SELECT event_id AS fix_id, user_id AS src_seq, CASE WHEN event_id % 5 <> 0 THEN cast(event_id % 30 as double) END AS ratio FROM {events}"
add(
    "J12_apply_routes",
    lambda s, d: ops.apply_routes(a := derive(s, d, ANS), a.where("fix_id % 3 = 0").withColumn("route_ratio", F.lit(33.0)), a.where("fix_id % 2 = 0").withColumn("coverage", F.when(C("fix_id") % 4 == 0, 0.99).otherwise(0.5))),
    f"""WITH a AS ({plain(ANS)}), t AS (SELECT *, CASE WHEN fix_id % 3 = 0 THEN 'routed' WHEN fix_id % 4 = 0 AND ratio IS NOT NULL THEN 'blocked' WHEN fix_id % 2 = 0 THEN 'unchecked' END AS terrain FROM a)
    SELECT fix_id, src_seq, CASE terrain WHEN 'routed' THEN cast(33 as double) WHEN 'blocked' THEN NULL ELSE ratio END AS ratio, terrain FROM t""",
)
INDEX = "SELECT doc_id AS key, cast(2 as bigint) AS version, md5(text) AS hash FROM {documents} WHERE doc_id % 10 <> 9"
HELD = "SELECT doc_id AS key, cast(1 as bigint) AS version, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE 'old' END AS hash FROM {documents} UNION ALL SELECT doc_id AS key, cast(2 as bigint) AS version, md5(text) AS hash FROM {documents} WHERE doc_id % 5 < 2"
add(
    "J16_reconcile_versions",
    lambda s, d: ops.reconcile_versions(derive(s, d, INDEX), derive(s, d, HELD)),
    f"""WITH h AS ({plain(HELD)}), i AS ({plain(INDEX)}) SELECT h.key, h.version, CASE WHEN h.version = i.version THEN 'current' WHEN h.hash = i.hash THEN 'adopt'
    WHEN i.key IS NOT NULL AND EXISTS (SELECT 1 FROM h o WHERE o.key = h.key AND o.version = 2) THEN 'sweep' ELSE 'keep' END AS state FROM h LEFT JOIN i USING (key)""",
)
NOTES = "SELECT doc_id % 37 AS gid, doc_id AS src_seq, lang, CASE WHEN doc_id % 2 = 0 THEN 'Aerodrome ' ELSE '' END || 'note x' || cast(doc_id % 7 as varchar(2)) AS note FROM {documents}"
add(
    "A6_merge_notes",
    lambda s, d: ops.merge_notes(derive(s, d, NOTES)).withColumn("note", F.md5("note")),
    f"WITH n AS (SELECT gid, lang, min(src_seq) AS seq, arg_min(note, src_seq) AS note FROM ({plain(NOTES)}) x GROUP BY gid, lang, src_seq % 7) SELECT gid, lang, md5(string_agg(note, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY seq)) AS note FROM n GROUP BY gid, lang",
)
add(
    "A7_merge_sources",
    lambda s, d: ops.merge_sources(derive(s, d, "SELECT doc_id % 37 AS gid, doc_id AS src_seq, source FROM {documents}")),
    "SELECT gid, string_agg(source, ' + ' ORDER BY seq) AS name, cast(sum(n) as bigint) AS merged FROM (SELECT doc_id % 37 AS gid, source, min(doc_id) AS seq, count(*) AS n FROM documents GROUP BY 1, 2) x GROUP BY gid",
)
TILES = f"SELECT cast(ceil(lat) - 1 as bigint) AS lat0, cast(floor(lon) as bigint) AS lon0, count(*) * 1000 AS bytes FROM ({fx.SITES_A}) s WHERE src_seq % 3 <> 0 GROUP BY 1, 2"
add(
    "A16_tiles_for_sites",
    lambda s, d: ops.tiles_for_sites(sites(s, d).where("src_seq % 9 = 0"), derive(s, d, TILES), "country"),
    f"{S}, t AS ({plain(TILES)}), b AS (SELECT country, min(lat) AS a, max(lat) AS z, min(lon) AS w, max(lon) AS e FROM sites WHERE src_seq % 9 = 0 GROUP BY country) SELECT country, count(*) AS tiles, cast(sum(bytes) as bigint) AS bytes FROM b JOIN t ON lat0 BETWEEN ceil(a) - 1 AND ceil(z) - 1 AND lon0 BETWEEN floor(w) AND floor(e) GROUP BY country",
)
PHOTOS = """SELECT event_id % 500 AS submission, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 45 + event_id % 11 / cast(1000 as double) END AS gps_lat, cast(7 as double) AS gps_lon,
  CASE WHEN event_id % 2 = 0 THEN 45 + event_id % 13 / cast(1000 as double) END AS device_lat, cast(7 as double) AS device_lon, cast(45 as double) AS field_lat, cast(7 as double) AS field_lon FROM {events}"""
add(
    "A17_geo_verdict",
    lambda s, d: ops.geo_verdict(derive(s, d, PHOTOS), 1000.0),
    f"""WITH p AS (SELECT *, {hav('gps_lat', 'gps_lon', 'field_lat', 'field_lon')} AS o, {hav('device_lat', 'device_lon', 'field_lat', 'field_lon')} AS v FROM ({plain(PHOTOS)}) x),
    q AS (SELECT submission, pos, CASE WHEN gps_lat IS NOT NULL THEN 'exif' WHEN device_lat IS NOT NULL AND v <= 1000 THEN 'device' ELSE 'none' END AS source, CASE WHEN gps_lat IS NOT NULL THEN o WHEN device_lat IS NOT NULL AND v <= 1000 THEN v END AS d FROM p),
    r AS (SELECT *, d IS NOT NULL AND d <= 1000 AS ok, row_number() OVER (PARTITION BY submission ORDER BY CASE WHEN d <= 1000 THEN 1 ELSE 0 END, pos) AS n FROM q)
    SELECT submission, bool_and(ok) AS verified, max(source) FILTER (n = 1) AS source, cast(max(floor(d + 0.5)) FILTER (n = 1) as bigint) AS distance_m FROM r GROUP BY submission""",
)
REFS = "SELECT l_suppkey % 9 AS pack, 'media/' || cast(l_partkey % 300 as varchar(9)) || '.jpg' AS url, CASE WHEN l_partkey % 2 = 0 THEN 'https://x/' || cast(l_partkey as varchar(9)) ELSE '' END AS thumb, cast(null as varchar(9)) AS doc FROM {lineitem}"
add(
    "A19_local_refs",
    lambda s, d: ops.local_refs(derive(s, d, REFS), "pack", ["url", "thumb", "doc"]),
    "SELECT DISTINCT l_suppkey % 9 AS pack, 'media/' || cast(l_partkey % 300 as varchar) || '.jpg' AS ref FROM lineitem",
)
SHORT = "SELECT doc_id AS id, lang, 'note ' || cast(doc_id % 50 as varchar(9)) AS text FROM {documents}"
TM = "SELECT DISTINCT 'fr' AS lang, 'note ' || cast(doc_id % 50 as varchar(9)) AS text, 'remarque ' || cast(doc_id % 50 as varchar(9)) AS translation FROM {documents} WHERE doc_id % 50 < 30"
add(
    "T4_localize",
    lambda s, d: ops.localize(derive(s, d, SHORT), derive(s, d, TM), ["en", "fr", "de"]),
    f"SELECT id, l.lang, CASE WHEN l.lang = 'fr' AND n.lang <> 'fr' AND id % 50 < 30 THEN 'remarque ' || cast(id % 50 as varchar) ELSE text END AS text FROM ({plain(SHORT)}) n CROSS JOIN (SELECT unnest(['en', 'fr', 'de']) AS lang) l",
)
add(
    "D3_build_report",
    lambda s, d: ops.build_report(sources=(sites(s, d), "source"), grades=(sites(s, d), "difficulty"), documents=(derive(s, d, fx.EDITIONS), "lang")),
    f"{S} SELECT 'sources' AS part, source AS value, count(*) AS n FROM sites GROUP BY 2 UNION ALL SELECT 'grades', difficulty, count(*) FROM sites GROUP BY 2 UNION ALL SELECT 'documents', lang, count(*) FROM documents GROUP BY 2",
)
LINK = r"""'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'"""
add(
    "S12_extract_links",
    lambda s, d: ops.extract_links(derive(s, d, "SELECT page_id, url, html FROM {pages}")).select("page_id", "place", "href"),
    f"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, {LINK}, 1)) AS href, unnest(range(len(regexp_extract_all(html, {LINK}, 1)))) AS place FROM pages)
    SELECT page_id, place, CASE WHEN regexp_matches(href, '(?i)^[a-z]+:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE regexp_extract(url, '^(.*/)', 1) || href END AS href FROM h""",
)
