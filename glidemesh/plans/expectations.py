"""Expectations on packs, ordered documents and the plan of a sync, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.operators import expectations as ex
from glidemesh.operators import packs
from glidemesh.sources.fixtures import derive, plain

QUERIES, ORACLES = {}, {}
V = lambda c: f"cast({c} as varchar(20))"

PACKS = f"""SELECT n_name AS pack, CASE WHEN n_nationkey % 9 = 0 THEN '' WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS manifest_id,
  'v' || {V('n_regionkey')} AS version, CASE WHEN n_nationkey % 6 = 0 THEN 'fields.json' WHEN n_nationkey % 6 = 1 THEN './x.json' END AS fields_url,
  n_nationkey % 3 <> 0 AS has_media_manifest, n_nationkey % 8 <> 0 AS media_manifest_ok,
  CASE WHEN n_nationkey % 5 = 0 THEN cast(null as varchar(20)) ELSE 'v' || {V('n_nationkey % 5')} END AS media_version, n_nationkey % 7 <> 0 AS has_state FROM {{nation}}
  UNION ALL SELECT s_name, s_name, 'v1', NULL, true, true, 'v1', true FROM {{supplier}}"""
SITES = f"""SELECT n_name AS pack, c_custkey AS pos, CASE WHEN c_custkey % 13 = 0 THEN cast(null as varchar(20)) ELSE 's' || {V('c_custkey % 37')} END AS site_id,
  CASE WHEN c_custkey % 17 = 0 THEN cast(null as varchar(20)) ELSE c_name END AS name, CASE WHEN c_custkey % 19 <> 0 THEN c_acctbal / 100 END AS lat, c_acctbal / 40 - 60 AS lon,
  c_custkey % 11 <> 0 AS noted, c_custkey % 5 <> 0 AS en, c_custkey % 23 <> 0 AS fr, c_custkey % 7 <> 0 AS de FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""
K = V("o_orderkey")
MEDIA = f"""SELECT n_name AS pack, c_custkey AS pos, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ' PDF' ELSE 'image' END AS type,
  CASE o_orderkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'https://x/' || {K} WHEN 2 THEN 'media/' || {K} || '.jpg' WHEN 3 THEN './media/a/../' || {K} || '.pdf'
    WHEN 4 THEN '../_shared/' || {K} || '.jpg' WHEN 5 THEN '../../etc/' || {K} WHEN 6 THEN '/abs/' || {K} || '.jpg' WHEN 7 THEN 'media/../../OTHER/' || {K} || '.JPG' END AS url
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey"""
FILES = f"""SELECT CASE o_orderkey % 9 WHEN 2 THEN n_name || '/media/' || {K} || '.jpg' WHEN 3 THEN n_name || '/media/' || {K} || '.pdf' WHEN 4 THEN '_shared/' || {K} || '.jpg' ELSE 'OTHER/' || {K} || '.JPG' END AS path
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey WHERE o_orderkey % 5 <> 0"""


def add(name, fn, sql):
    QUERIES[name] = fn
    ORACLES[name] = sql


def checked(s, d):
    each = derive(s, d, MEDIA).groupBy("pos").agg(F.collect_list(F.struct("url", "type")).alias("media"))
    notes = F.map_from_entries(F.filter(F.array(*[F.when(F.col(x), F.struct(F.lit(x), F.lit("note"))) for x in ex.LANGS]), lambda x: x.isNotNull()))
    sites = derive(s, d, SITES).join(each, "pos", "left").withColumn("notes", F.when(F.col("noted"), notes))
    return ex.check_packs(derive(s, d, PACKS), sites, derive(s, d, FILES), most_missing=2)


NORM = "regexp_replace(pack || '/' || trim(url), '/(\\./)+', '/', 'g')"
for _ in range(3):
    NORM = f"regexp_replace({NORM}, '[^/.][^/]*/\\.\\./', '')"
HEAD = f"""WITH packs AS ({plain(PACKS)}), sites AS (SELECT *, coalesce(nullif(trim(site_id), ''), cast(pos as varchar)) AS key FROM ({plain(SITES)}) s), files AS (SELECT DISTINCT path FROM ({plain(FILES)}) f),
media AS (SELECT m.*, key, coalesce(trim(url), '') = '' AS blank, coalesce(url LIKE 'http%' OR url LIKE 'data:%', false) AS remote, {NORM} AS way FROM ({plain(MEDIA)}) m JOIN sites USING (pack, pos)),
local AS (SELECT *, way LIKE '../%' OR url LIKE '/%' AS escapes, lower(trim(type)) = 'pdf' OR lower(url) LIKE '%.pdf' AS pdf, way NOT IN (SELECT path FROM files) AS gone FROM media WHERE NOT blank AND NOT remote),
sums AS (SELECT pack, count(*) AS media, count(*) FILTER (NOT pdf) AS images, count(*) FILTER (pdf) AS pdfs, count(*) FILTER (gone AND NOT escapes) AS missing FROM local GROUP BY pack),
counts AS (SELECT p.pack, coalesce(n, 0) AS sites, coalesce(media, 0) AS media, coalesce(images, 0) AS images, coalesce(pdfs, 0) AS pdfs, coalesce(missing, 0) AS missing
  FROM packs p LEFT JOIN (SELECT pack, count(*) AS n FROM sites GROUP BY pack) x USING (pack) LEFT JOIN sums USING (pack))"""
KEYS = "[CASE WHEN site_id IS NULL THEN 'id' END, CASE WHEN name IS NULL THEN 'name' END, CASE WHEN lat IS NULL THEN 'latitude' END, CASE WHEN lon IS NULL THEN 'longitude' END]"
TONGUES = "[CASE WHEN NOT en THEN 'en' END, CASE WHEN NOT fr THEN 'fr' END, CASE WHEN NOT de THEN 'de' END]"
PARTS = [
    ("key-missing", "key", f"array_to_string({KEYS}, ',')", f"sites WHERE array_to_string({KEYS}, ',') <> ''"),
    ("latitude", "key", "NULL", "sites WHERE lat IS NULL OR abs(lat) > 90"),
    ("longitude", "key", "NULL", "sites WHERE lon IS NULL OR abs(lon) > 180"),
    ("note-language-missing", "key", f"array_to_string({TONGUES}, ',')", "sites WHERE noted AND NOT (en AND fr AND de)"),
    ("id-repeated", "site_id", "cast(count(*) - 1 as varchar)", "sites WHERE site_id IS NOT NULL GROUP BY pack, site_id HAVING count(*) > 1"),
    ("media-url-missing", "key", "NULL", "media WHERE blank"),
    ("media-not-local", "key", "url", "media WHERE remote"),
    ("media-escapes", "key", "url", "local WHERE escapes"),
    ("media-missing", "key", "url", "local WHERE gone AND NOT escapes"),
    ("media-missing-too-many", "pack", "cast(missing as varchar)", "counts WHERE missing > 2"),
    ("fields-empty", "pack", "NULL", "counts WHERE sites = 0"),
    ("manifest-id-missing", "pack", "NULL", "packs WHERE manifest_id = ''"),
    ("manifest-id-differs", "pack", "manifest_id", "packs WHERE manifest_id <> '' AND manifest_id <> pack"),
    ("fields-url-unusual", "pack", "fields_url", "packs WHERE fields_url NOT IN ('fields.json', './fields.json')"),
    ("media-manifest-absent", "pack", "NULL", "packs WHERE NOT has_media_manifest"),
    ("media-manifest-broken", "pack", "NULL", "packs WHERE has_media_manifest AND NOT media_manifest_ok"),
    ("media-version-differs", "pack", "media_version", "packs WHERE has_media_manifest AND media_manifest_ok AND media_version IS DISTINCT FROM version"),
    ("state-missing", "pack", "NULL", "packs WHERE NOT has_state"),
]
add(
    "D1_check_packs",
    lambda s, d: checked(s, d)[0].withColumn("detail", F.when(~F.col("rule").isin("latitude", "longitude"), F.col("detail"))),
    HEAD + " UNION ALL ".join(f" SELECT pack, '{r}' AS rule, '{ex.RULES[r]}' AS severity, {k} AS key, {v} AS detail FROM {w}" for r, k, v, w in PARTS),
)
add("D1_pack_counts", lambda s, d: checked(s, d)[1], f"{HEAD} SELECT pack, sites, media, images, pdfs, missing FROM counts")

#: Editions of charts: two languages, slots with suffixes of one and more numbers, and types that are not wanted.
CHARTS = f"""SELECT l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS code, CASE l_partkey % 5 WHEN 0 THEN 'adc' WHEN 1 THEN 'SID' ELSE 'VAC' END AS type,
  CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_partkey % 7 < 4 THEN '_' || {V('l_partkey % 14')} ELSE '_' || {V('l_partkey % 12')} || '-' || {V('l_partkey % 3')} END AS suffix,
  CASE WHEN l_linenumber % 3 = 0 THEN 'En' ELSE 'es' END AS lang FROM {{lineitem}}"""
add(
    "W6_ordered_documents",
    lambda s, d: packs.ordered_documents(derive(s, d, CHARTS), "en", ["VAC", "ADC"]).select("code", F.array_join(F.transform("documents", lambda x: x.cast("string")), ",").alias("documents"), F.size("documents").cast("long").alias("n")),
    f"""WITH c AS (SELECT seq, code, upper(type) AS type, suffix, lower(lang) = 'en' AS wanted FROM ({plain(CHARTS)}) x WHERE upper(type) IN ('VAC', 'ADC')),
    o AS (SELECT code, type, suffix, min(seq) AS first, coalesce(min(seq) FILTER (wanted), min(seq)) AS seq FROM c GROUP BY ALL),
    n AS (SELECT *, CASE WHEN regexp_matches(suffix, '[0-9]') THEN cast(regexp_extract_all(suffix, '[0-9]+') as bigint[]) ELSE [0] END AS place FROM o)
    SELECT code, string_agg(cast(seq as varchar), ',' ORDER BY CASE type WHEN 'VAC' THEN 0 ELSE 1 END, place, first) AS documents, count(*) AS n FROM n GROUP BY code""",
)

#: Files that are wanted with the size they should have, and files that are held with the size they have.
WANTED = "SELECT o_orderkey AS path, CASE WHEN o_orderkey % 6 = 0 THEN cast(null as bigint) ELSE cast(floor(o_totalprice) as bigint) END AS bytes FROM {orders} WHERE o_orderkey % 10 <> 3"
HELD = "SELECT o_orderkey AS path, CASE o_orderkey % 8 WHEN 1 THEN cast(0 as bigint) WHEN 2 THEN cast(floor(o_totalprice) as bigint) + 1 ELSE cast(floor(o_totalprice) as bigint) END AS bytes FROM {orders} WHERE o_orderkey % 7 <> 0"
SYNC = f"""WITH w AS ({plain(WANTED)}), h AS ({plain(HELD)})
SELECT coalesce(w.path, h.path) AS path, CASE WHEN w.path IS NULL THEN 'evict' WHEN h.path IS NULL OR ({{drift}} AND w.bytes > 0 AND h.bytes > 0 AND w.bytes <> h.bytes) THEN 'fetch' ELSE 'keep' END AS action FROM w FULL JOIN h ON w.path = h.path"""
for name, drift in (("J15_sync_files_drifted", True), ("J15_sync_files", False)):
    add(name, lambda s, d, drift=drift: packs.sync_files(derive(s, d, WANTED), derive(s, d, HELD), drift), SYNC.format(drift=str(drift).lower()))
