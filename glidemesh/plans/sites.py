"""Registered queries over sites: scalars, joins, resolution and ranking, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.functions import geo, text
from glidemesh.operators import answers, packs, resolve
from glidemesh.sources import fixtures as fx
from glidemesh.sources.fixtures import derive, plain

QUERIES, ORACLES = {}, {}
C = F.col


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def sites(spark, d):
    return derive(spark, d, fx.SITES)


S = f"WITH RECURSIVE sites AS ({plain(fx.SITES)}), fixes AS ({plain(fx.FIXES)})"
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def hav(a, b, c, d):
    return HAV.format(a=a, b=b, c=c, d=d)


def bearing(a, b, c, d):
    dl = f"(radians({d}) - radians({b}))"
    x = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({dl})"
    deg = f"(degrees(atan2(sin({dl}) * cos(radians({c})), {x})) + 360)"
    return f"({deg} - 360 * floor({deg} / 360))"


# -- scalars

add(
    "G1_G2_distance_bearing",
    lambda s, d: sites(s, d).select(
        "site_id",
        F.round(geo.haversine_m(C("lat"), C("lon"), F.lit(45.0), F.lit(7.0))).cast("long").alias("d_m"),
        F.round(geo.bearing_deg(C("lat"), C("lon"), F.lit(45.0), F.lit(7.0)), 3).alias("bearing"),
    ),
    f"{S} SELECT site_id, cast(round({hav('lat', 'lon', '45.0', '7.0')}) as bigint) AS d_m, round({bearing('lat', 'lon', '45.0', '7.0')}, 3) AS bearing FROM sites",
)
add(
    "G3_tile_key",
    lambda s, d: sites(s, d).select("site_id", geo.tile_key(C("lat"), C("lon")).alias("tile")),
    f"{S} SELECT site_id, 'N' || lpad(cast(cast(ceil(lat) - 1 as int) as varchar), 2, '0') || 'E' || lpad(cast(cast(floor(lon) as int) as varchar), 3, '0') AS tile FROM sites",
)
add(
    "G4_lattice",
    lambda s, d: sites(s, d).select("site_id", F.floor((90 - C("lat")) * 1200).cast("long").alias("row"), F.floor((C("lon") + 180) * 1200).cast("long").alias("col")),
    f"{S} SELECT site_id, cast(floor((90 - lat) * 1200) as bigint) AS row, cast(floor((lon + 180) * 1200) as bigint) AS col FROM sites",
)
add(
    "G5_heading_delta",
    lambda s, d: sites(s, d).select("site_id", geo.heading_delta(C("heading_deg"), F.lit(80.0)).alias("delta")),
    f"{S} SELECT site_id, least(abs(heading_deg - 80.0) % 180, 180 - abs(heading_deg - 80.0) % 180) AS delta FROM sites WHERE heading_deg IS NOT NULL UNION ALL SELECT site_id, NULL FROM sites WHERE heading_deg IS NULL",
)
add(
    "F1_F2_coordinates",
    lambda s, d: sites(s, d).select(
        "site_id", text.format_cup_coord(C("lat"), True).alias("la"), text.format_cup_coord(-C("lon"), False).alias("lo")
    ).withColumn("back", F.round(text.parse_coord(C("la"), True), 4)),
    f"""{S}, m AS (SELECT site_id, cast(floor(lat * 60000 + 0.5) as bigint) AS a, cast(floor(lon * 60000 + 0.5) as bigint) AS o FROM sites)
    SELECT site_id, lpad(cast(a // 60000 as varchar), 2, '0') || lpad(cast(a % 60000 // 1000 as varchar), 2, '0') || '.' || lpad(cast(a % 1000 as varchar), 3, '0') || 'N' AS la,
    lpad(cast(o // 60000 as varchar), 3, '0') || lpad(cast(o % 60000 // 1000 as varchar), 2, '0') || '.' || lpad(cast(o % 1000 as varchar), 3, '0') || 'W' AS lo,
    round(a // 60000 + cast(cast(a % 60000 // 1000 as varchar) || '.' || lpad(cast(a % 1000 as varchar), 3, '0') as double) / 60, 4) AS back FROM m""",
)
add(
    "F3_length_m",
    lambda s, d: derive(s, d, "SELECT p_partkey, p_size * 20 || CASE p_partkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN ' ft' ELSE '' END AS raw FROM {part}").select("p_partkey", text.parse_length_m(C("raw")).alias("length_m")),
    "SELECT p_partkey, round_even(CASE WHEN p_partkey % 3 = 1 THEN p_size * 20 * cast(0.3048 as double) ELSE cast(p_size * 20 as double) END, 1) AS length_m FROM part",
)
add(
    "F5_F11_width_heading",
    lambda s, d: derive(s, d, "SELECT p_partkey, p_size * 20 || ' x ' || p_size || ' RWY ' || p_partkey % 400 AS raw, 'RWY ' || p_partkey % 400 AS rwy FROM {part}").select("p_partkey", text.parse_width_m(C("raw")).alias("width_m"), text.parse_heading_deg(C("rwy")).cast("long").alias("heading")),
    "SELECT p_partkey, CASE WHEN p_size * 20 >= 10 THEN cast(p_size as double) END AS width_m, cast(CASE WHEN p_partkey % 400 <= 36 THEN p_partkey % 400 * 10 WHEN p_partkey % 400 <= 360 THEN p_partkey % 400 END as bigint) AS heading FROM part",
)
add(
    "F13_mine_frequencies",
    lambda s, d: derive(s, d, fx.FREQS).withColumn("t", F.concat_ws(" ", "description", F.format_string("%.3f", "mhz"), F.lit("AFIS 121,5"))).select("src_seq", F.transform(text.mine_frequencies(C("t")), lambda x: F.round(x * 1000).cast("long")).alias("l")).select("src_seq", F.array_join("l", ",").alias("khz")),
    f"WITH f AS ({plain(fx.FREQS)}) SELECT src_seq, CASE WHEN cast(round(mhz * 1000) as bigint) BETWEEN 118000 AND 137000 AND cast(round(mhz * 1000) as bigint) <> 121500 THEN CASE WHEN mhz < 121.5 THEN cast(cast(round(mhz * 1000) as bigint) as varchar) || ',121500' ELSE '121500,' || cast(cast(round(mhz * 1000) as bigint) as varchar) END ELSE '121500' END AS khz FROM f",
)
add(
    "F14_format_freq",
    lambda s, d: derive(s, d, fx.FREQS).select("src_seq", text.format_freq(C("mhz"), F.when(C("type") == 3, "AFIS").when(C("type") == 4, "other").otherwise(C("type").cast("string"))).alias("label")),
    f"WITH f AS ({plain(fx.FREQS)}) SELECT src_seq, printf('%.3f', mhz) || CASE WHEN type = 3 THEN ' AFIS' ELSE '' END AS label FROM f",
)
add(
    "F17_match_name",
    lambda s, d: sites(s, d).select("site_id", text.match_name(C("name")).alias("name"), text.slugify(C("name")).alias("slug")),
    f"""{S} SELECT site_id, trim(regexp_replace(' ' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') || ' ', ' aerodrome ', ' ')) AS name,
    regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM sites""",
)
add(
    "F18_F19_directions_jaccard",
    lambda s, d: derive(s, d, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Field Nord' WHEN 1 THEN 'Field sued' WHEN 2 THEN 'West est' ELSE 'Field' END AS a, 'field north' AS b FROM {part}").select("p_partkey", F.array_join(text.direction_tokens(C("a")), ",").alias("dirs"), text.directions_conflict(C("a"), C("b")).alias("conflict"), F.round(text.token_jaccard(F.lower("a"), C("b")), 3).alias("jaccard")),
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN 's' WHEN 2 THEN 'e,w' ELSE '' END AS dirs, p_partkey % 4 IN (1, 2) AS conflict,
    cast(CASE p_partkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 0.5 ELSE 0.333 END as double) AS jaccard FROM part""",
)
add(
    "F21_strip_html",
    lambda s, d: derive(s, d, "SELECT page_id, html FROM {pages}").select("page_id", F.md5(text.strip_html(C("html"))).alias("digest")),
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b)
    SELECT page_id, md5(trim(regexp_replace(h, '[ \t\n\r\f]+', ' ', 'g'))) AS digest FROM c""",
)
add(
    "F27_compass",
    lambda s, d: sites(s, d).select("site_id", geo.compass_point(C("heading_deg") + 5).alias("point")),
    f"{S} SELECT site_id, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[cast(floor((heading_deg + 5) / 22.5 + 0.5) as bigint) % 16 + 1] AS point FROM sites",
)
add(
    "F29_difficulty_label",
    lambda s, d: sites(s, d).select("site_id", text.difficulty_label(F.lower("difficulty")).alias("label")),
    f"{S} SELECT site_id, CASE difficulty WHEN 'UNKNOWN' THEN '?' ELSE difficulty END AS label FROM sites",
)
add(
    "F34_airac_dates",
    lambda s, d: derive(s, d, "SELECT DISTINCT cast(o_orderdate as date) AS today FROM {orders}").select("today", F.expr("date_add(date'2024-01-25', cast(floor(datediff(today, date'2024-01-25') / 28) as int) * 28)").alias("cycle")),
    "SELECT DISTINCT cast(o_orderdate as date) AS today, cast(date '2024-01-25' + cast(floor((cast(o_orderdate as date) - date '2024-01-25') / 28) as int) * 28 as date) AS cycle FROM orders",
)

# -- enrichment and aggregation

ENRICH = f"WITH airports AS ({plain(fx.AIRPORTS)}), runways AS ({plain(fx.RUNWAYS)}), freqs AS ({plain(fx.FREQS)})"
add(
    "A8_longest_runway",
    lambda s, d: packs.longest_runway(derive(s, d, fx.RUNWAYS)),
    f"{ENRICH} SELECT airport, length_m, heading FROM (SELECT *, row_number() OVER (PARTITION BY airport ORDER BY length_m DESC, src_seq) AS r FROM runways) x WHERE r = 1",
)


def j2(s, d):
    a, r, f = (derive(s, d, q) for q in (fx.AIRPORTS, fx.RUNWAYS, fx.FREQS))
    n = f.where("mhz between 118 and 137").groupBy("airport").agg(F.count("*").alias("n_freqs"))
    return a.join(packs.longest_runway(r).withColumnRenamed("airport", "src_seq"), "src_seq", "left").join(n.withColumnRenamed("airport", "src_seq"), "src_seq", "left").select("src_seq", "code", "name", "length_m", "heading", F.coalesce("n_freqs", F.lit(0)).alias("n_freqs"))


add(
    "J2_make_airfields",
    j2,
    f"""{ENRICH}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY airport ORDER BY length_m DESC, src_seq) AS r FROM runways) x WHERE r = 1),
    n AS (SELECT airport, count(*) AS n FROM freqs WHERE mhz BETWEEN 118 AND 137 GROUP BY airport)
    SELECT a.src_seq, code, name, length_m, heading, coalesce(n, 0) AS n_freqs FROM airports a LEFT JOIN l ON l.airport = a.src_seq LEFT JOIN n ON n.airport = a.src_seq""",
)
add(
    "J3_new_airports",
    lambda s, d: derive(s, d, fx.AIRPORTS).where("code <> ''").join(sites(s, d).where("src_seq % 2 = 0").select("code"), "code", "left_anti").select("src_seq", "code"),
    f"{S}, airports AS ({plain(fx.AIRPORTS)}) SELECT src_seq, code FROM airports WHERE code <> '' AND code NOT IN (SELECT code FROM sites WHERE src_seq % 2 = 0)",
)
add(
    "J4_keep_codes",
    lambda s, d: sites(s, d).join(derive(s, d, fx.AIRPORTS).where("code <> ''").select("code"), "code", "left_semi").select("site_id", "code"),
    f"{S}, airports AS ({plain(fx.AIRPORTS)}) SELECT site_id, code FROM sites WHERE code IN (SELECT code FROM airports WHERE code <> '')",
)
add(
    "A10_type_mix",
    lambda s, d: packs.type_mix(derive(s, d, fx.AIRPORTS)),
    f"{ENRICH} SELECT country, type, n, place FROM (SELECT country, type, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, type) AS place FROM airports GROUP BY country, type) x WHERE place <= 8",
)


def a4(s, d):
    f = derive(s, d, fx.FREQS).withColumns({"score": F.when(C("type") % 2 == 0, 90).otherwise(50), "role": C("type") % 3})
    return resolve.merge_freqs(f.where("mhz between 118 and 137"), "airport").select("airport", F.array_join(F.transform("freqs", lambda x: F.concat_ws(":", x.role.cast("string"), F.format_string("%.3f", x.mhz), x.type.cast("string"))), ",").alias("freqs"))


add(
    "A4_merge_freqs",
    a4,
    f"""{ENRICH}, b AS (SELECT airport, round(mhz, 3) AS mhz, type % 3 AS role, type, row_number() OVER (PARTITION BY airport, round(mhz, 3) ORDER BY CASE WHEN type % 2 = 0 THEN 90 ELSE 50 END DESC, src_seq) AS r FROM freqs WHERE mhz BETWEEN 118 AND 137)
    SELECT airport, string_agg(cast(role as varchar) || ':' || printf('%.3f', mhz) || ':' || cast(type as varchar), ',' ORDER BY role, mhz, type) AS freqs FROM b WHERE r = 1 GROUP BY airport""",
)
add(
    "A9_dedupe_last",
    lambda s, d: derive(s, d, fx.FREQS).groupBy("airport", "type").agg(F.max_by("description", "src_seq").alias("last"), F.max("src_seq").alias("src_seq")),
    f"{ENRICH} SELECT airport, type, arg_max(description, src_seq) AS last, max(src_seq) AS src_seq FROM freqs GROUP BY airport, type",
)
add(
    "S7_union_sources",
    lambda s, d: derive(s, d, fx.SITES_A).unionByName(derive(s, d, fx.SITES_B), allowMissingColumns=True).groupBy("source", "country").agg(F.count("*").alias("n"), F.min("src_seq").alias("first_seq")),
    f"{S} SELECT source, country, count(*) AS n, min(src_seq) AS first_seq FROM sites GROUP BY source, country",
)
add(
    "P2_drop_major",
    lambda s, d: packs.drop_major(sites(s, d), ["LFAM", "LFBA"], ["LFAY"]).select("site_id", "kind", "length_m"),
    f"{S} SELECT site_id, kind, length_m FROM sites WHERE NOT (kind = 'airfield' AND (code IN ('LFAM', 'LFBA') OR (code <> 'LFAY' AND length_m >= 2000)))",
)
add(
    "D1_check_sites",
    lambda s, d: packs.check_sites(sites(s, d)),
    f"""{S} SELECT 'grade-unknown' AS rule, 'warning' AS severity, count(*) AS n FROM sites WHERE difficulty = 'UNKNOWN' HAVING count(*) > 0
    UNION ALL SELECT 'heading-missing', 'warning', count(*) FROM sites WHERE heading_deg IS NULL HAVING count(*) > 0""",
)

# -- resolution

PAIRS = f"""{S}, named AS (SELECT *, trim(regexp_replace(' ' || regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g') || ' ', ' aerodrome ', ' ')) AS mn,
  cast(floor(lat / 0.01) as bigint) AS gy, cast(floor(lon / 0.02) as bigint) AS gx FROM sites),
p0 AS (SELECT x.src_seq AS a, y.src_seq AS b, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS d, x.mn AS mx, y.mn AS my, x.heading_deg AS hx, y.heading_deg AS hy, x.elev_m AS ex, y.elev_m AS ey, x.code AS cx, y.code AS cy
  FROM named x JOIN named y ON x.src_seq < y.src_seq AND y.gy BETWEEN x.gy - 1 AND x.gy + 1 AND y.gx BETWEEN x.gx - 1 AND x.gx + 1),
p1 AS (SELECT *, len(list_intersect(string_split(mx, ' '), string_split(my, ' '))) / len(list_distinct(list_concat(string_split(mx, ' '), string_split(my, ' ')))) AS j FROM p0 WHERE d <= 800),
pairs AS (SELECT a, b, cast(round(d) as bigint) AS d_m FROM p1 WHERE
  (d <= 400 AND least(abs(hx - hy) % 180, 180 - abs(hx - hy) % 180) <= 10 AND abs(ex - ey) <= 15)
  OR mx = my OR j >= 0.85 OR (d <= 350 AND (contains(mx, my) OR contains(my, mx) OR j >= 0.62)))"""
add("J5_duplicate_pairs", lambda s, d: resolve.duplicate_pairs(sites(s, d)), f"{PAIRS} SELECT a, b, d_m FROM pairs")
REACH = """, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT a AS id, a AS other FROM e UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.other)"""
add(
    "R1_components",
    lambda s, d: resolve.connected_components(resolve.duplicate_links(sites(s, d))),
    f"{PAIRS}{REACH} SELECT id, min(other) AS gid FROM walk GROUP BY id",
)
add(
    "A1_A2_golden_records",
    lambda s, d: resolve.merge_groups(resolve.consolidate(sites(s, d))).select("gid", "name", "code", "elev_m", "heading_deg", "kind", "difficulty", "merged", "sources"),
    f"""{S}, cn AS (SELECT code FROM sites WHERE code <> '' GROUP BY code HAVING count(*) >= 2), {PAIRS.split('named AS', 1)[1].join(['named AS', '']).replace('FROM sites)', 'FROM sites WHERE code NOT IN (SELECT code FROM cn))', 1)}{REACH},
    g AS (SELECT s.*, CASE WHEN code IN (SELECT code FROM cn) THEN min(src_seq) OVER (PARTITION BY code) ELSE coalesce((SELECT min(other) FROM walk WHERE id = s.src_seq), src_seq) END AS gid,
      CASE source WHEN 'official' THEN 300 WHEN 'openaip' THEN 200 ELSE 100 END + CASE WHEN code <> '' THEN 10 ELSE 0 END + CASE WHEN elev_m IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN heading_deg IS NOT NULL THEN 1 ELSE 0 END AS sc FROM sites s)
    SELECT gid, arg_max(name, sc * 1000000000.0 - src_seq) AS name,
      min(code) FILTER (code <> '') AS code, arg_max(elev_m, sc * 1000000000.0 - src_seq) FILTER (elev_m IS NOT NULL) AS elev_m,
      arg_max(heading_deg, sc * 1000000000.0 - src_seq) FILTER (heading_deg IS NOT NULL) AS heading_deg,
      CASE WHEN bool_or(kind = 'airfield') THEN 'airfield' ELSE 'outlanding' END AS kind,
      coalesce(max(difficulty) FILTER (difficulty <> 'UNKNOWN'), 'UNKNOWN') AS difficulty, count(*) AS merged,
      array_to_string(list_sort(list(DISTINCT source)), ' + ') AS sources FROM g GROUP BY gid""",
)
NEAR = f"""{S}, k AS (SELECT fix_id, s.src_seq, {hav('f.lat', 'f.lon', 's.lat', 's.lon')} AS d FROM fixes f JOIN sites s ON s.lat BETWEEN f.lat - 0.2 AND f.lat + 0.2 AND s.lon BETWEEN f.lon - 0.3 AND f.lon + 0.3)"""
add(
    "J6_nearest_within",
    lambda s, d: resolve.nearest_within(derive(s, d, fx.FIXES), sites(s, d), 10_000.0, "fix_id").select("fix_id", C("site.src_seq").alias("src_seq"), "d_m"),
    f"{NEAR} SELECT fix_id, src_seq, cast(round(d) as bigint) AS d_m FROM (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY d, src_seq DESC) AS r FROM k WHERE d <= 10000) x WHERE r = 1",
)

# -- ranking

SCORED = f"""{S}, scored AS (SELECT f.fix_id, s.src_seq, s.kind, s.difficulty, d, CASE WHEN f.alt_m - s.elev_m - 250.0 > 0 THEN d / (f.alt_m - s.elev_m - 250.0) END AS ratio, f.alt_m - s.elev_m - 250.0 AS usable
  FROM (SELECT f.*, s.src_seq, {hav('f.lat', 'f.lon', 's.lat', 's.lon')} AS d FROM fixes f JOIN sites s ON s.lat BETWEEN f.lat - 0.6 AND f.lat + 0.6) f JOIN sites s USING (src_seq) WHERE d <= 60000),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY ratio NULLS LAST, d, src_seq) AS rank FROM scored),
picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fix_id ORDER BY CASE WHEN kind <> 'airfield' THEN 1 ELSE 0 END, ratio, src_seq) AS pick FROM scored WHERE difficulty = 'A' AND ratio <= 25) x WHERE pick <= 3)"""


def scored(s, d):
    return answers.score_pairs(sites(s, d), derive(s, d, fx.FIXES))


add(
    "G6_J10_score_pairs",
    lambda s, d: answers.count_answers(sites(s, d), derive(s, d, fx.FIXES)).withColumn("best", F.round("best", 3)),
    f"{SCORED} SELECT fix_id, CASE WHEN usable <= 0 THEN 'too-low' ELSE 'ok' END AS reason, count(*) AS n, round(min(ratio), 3) AS best FROM scored GROUP BY 1, 2",
)
add(
    "P3_filter_difficulty",
    lambda s, d: answers.filter_difficulty(sites(s, d), True, False).select("site_id", "difficulty"),
    f"{S} SELECT site_id, difficulty FROM sites WHERE difficulty IN ('A', 'B', 'C')",
)
add(
    "W1_rank_answers",
    lambda s, d: answers.best_answers(sites(s, d), derive(s, d, fx.FIXES), 10).select("fix_id", "src_seq", "rank", F.round("ratio", 3).alias("ratio")),
    f"{SCORED} SELECT fix_id, src_seq, rank, round(ratio, 3) AS ratio FROM ranked WHERE rank <= 10",
)
add(
    "W2_top_picks",
    lambda s, d: answers.best_picks(sites(s, d), derive(s, d, fx.FIXES)).select("fix_id", "src_seq", "pick", F.round("ratio", 3).alias("ratio"), F.round("distance_m").cast("long").alias("d_m")),
    f"{SCORED} SELECT fix_id, src_seq, pick, round(ratio, 3) AS ratio, cast(round(d) as bigint) AS d_m FROM picks",
)
add(
    "W3_rest_list",
    lambda s, d: answers.rest_answers(sites(s, d), derive(s, d, fx.FIXES)),
    f"{SCORED} SELECT fix_id, src_seq, place FROM (SELECT r.fix_id, r.src_seq, row_number() OVER (PARTITION BY r.fix_id ORDER BY r.rank) AS place FROM ranked r ANTI JOIN picks p ON p.fix_id = r.fix_id AND p.src_seq = r.src_seq) x WHERE place <= 120",
)
add(
    "W4_solve_targets",
    lambda s, d: answers.targets_around(sites(s, d), derive(s, d, fx.FIXES)),
    f"{SCORED} SELECT fix_id, count(*) AS targets, cast(round(least(greatest(max(d) * 1.5, 15000.0), 90000.0)) as bigint) AS radius_m FROM ranked WHERE rank <= 80 GROUP BY fix_id",
)
add(
    "W12_rank_drift",
    lambda s, d: answers.drift_beyond(answers.best_answers(sites(s, d), derive(s, d, fx.FIXES), 10).drop("rank"), 20_000.0, 10),
    f"""{SCORED}, later AS (SELECT fix_id, src_seq, row_number() OVER (PARTITION BY fix_id ORDER BY ratio NULLS LAST, d, src_seq) AS l FROM scored WHERE d > 20000)
    SELECT r.fix_id, count(*) AS held, count(*) FILTER (l > 10) AS sank, count(*) FILTER (l IS NULL) AS gone FROM ranked r LEFT JOIN later USING (fix_id, src_seq) WHERE rank <= 10 GROUP BY r.fix_id""",
)
