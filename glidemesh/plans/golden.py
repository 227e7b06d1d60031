"""Registered queries over golden records, contributions, streams and small functions, each with its SQL twin."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from glidemesh.functions import geo, records, text
from glidemesh.operators import answers, contributions, golden
from glidemesh.operators import records as ops
from glidemesh.operators.resolve import checkpoint_folder
from glidemesh.plans import sites as site_plans
from glidemesh.plans.sites import S, hav, sites
from glidemesh.sources import fixtures as fx
from glidemesh.sources import sites as files
from glidemesh.sources.fixtures import derive, plain
from glidemesh.streaming.answers import read_answers, read_fixes, stream_answers

QUERIES, ORACLES = {}, {}
C = F.col


def add(name, fn, sql):
    QUERIES[name], ORACLES[name] = fn, sql


V = lambda e: f"cast({e} as varchar(20))"

#: Records of places: an order is a place, its lines are the records. Names are (as found, as shown).
NAMES = [
    ("LFMR barcelonnette", "Barcelonnette"), ("CHAMP DE LA cair", "Champ de la Cair"), ("#12 terrain du lac", "Terrain du Lac"),
    ("", ""), ("Piste 3 Nord", "Piste 3 Nord"), ("SUED feld LFNC", "Sud Feld"), ("VINON", "Vinon"),
]
_name = lambda i: "CASE l_partkey % 7 " + " ".join(f"WHEN {k} THEN '{n[i]}'" for k, n in enumerate(NAMES)) + " END"
RAW = f"""SELECT l_orderkey AS gid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + l_orderkey * 1000 AS src_seq, {_name(0)} AS name, {_name(1)} AS shown,
  CASE l_suppkey % 5 WHEN 0 THEN 'lf' || chr(cast(65 + l_partkey % 26 as int)) || 'X' WHEN 1 THEN 'FR_' || {V('l_partkey % 7')} WHEN 2 THEN '' WHEN 3 THEN ' LS12 ' ELSE 'LIAB' END AS code,
  CASE l_partkey % 4 WHEN 0 THEN 'FR' WHEN 1 THEN '' WHEN 2 THEN 'CH' END AS country,
  CASE WHEN l_quantity > 40 THEN 'airfield' ELSE 'outlanding' END AS kind,
  CASE l_partkey % 9 WHEN 0 THEN 'a' WHEN 1 THEN 'B' WHEN 2 THEN ' c' WHEN 3 THEN 'D' WHEN 4 THEN '' ELSE 'UNKNOWN' END AS difficulty,
  CASE l_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'normal' WHEN 2 THEN 'facile' END AS raw_difficulty,
  CASE l_suppkey % 6 WHEN 0 THEN 'OpenAIP' WHEN 1 THEN 'SIA VAC' WHEN 2 THEN 'Guide' WHEN 3 THEN 'planeur-net' WHEN 4 THEN 'openaip + sia' ELSE 'other' END AS source,
  CASE WHEN l_linenumber % 3 <> 0 THEN (43000 + l_partkey % 4000) / cast(1000 as double) END AS lat,
  CASE WHEN l_linenumber % 3 <> 0 THEN (5000 + l_partkey % 3000) / cast(1000 as double) END AS lon,
  CASE WHEN l_partkey % 2 = 0 THEN cast(l_partkey % 900 as double) END AS elev_m, CASE WHEN l_suppkey % 2 = 0 THEN cast(300 + l_partkey % 900 as double) END AS length_m,
  CASE WHEN l_partkey % 5 = 0 THEN cast(20 as double) END AS width_m, CASE WHEN l_partkey % 3 = 0 THEN cast(l_partkey % 360 as double) END AS heading_deg,
  CASE WHEN l_partkey % 6 = 0 THEN '123.500' ELSE '' END AS frequency, l_partkey % 3 AS n_freqs, l_suppkey % 2 AS n_media,
  CASE WHEN l_suppkey % 8 = 5 THEN 'SIA charts' ELSE 'photos' END AS media_source, CASE WHEN l_linenumber > 1 THEN 'vac' || {V('l_suppkey % 2')} END AS doc
  FROM {{lineitem}}"""


def dealt(s, d, sql, more=""):
    """Records by their SQL and ``more`` columns, from lines dealt by order before anything is made of them,
    so that all rules share one shuffle of few columns. The group is named after the numbers, or Spark
    would not see that groups are together already. The lines are few bytes but much work, so they are
    left in all the parts there are, which a number of parts sees to."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    rows = s.sql(f"{sql.removesuffix('FROM {lineitem}')}, l_orderkey{more} FROM {{lineitem}}", lineitem=lines)
    return rows.withColumn("gid", C("l_orderkey")).drop("l_orderkey")


def raw_fields(s, d):
    n = lambda c: C(c).cast("int")
    media = F.array_repeat(F.struct(C("media_source").alias("source")), n("n_media"))
    docs = F.when(C("doc").isNotNull(), F.create_map("doc", F.concat("doc", F.lit("-"), C("src_seq").cast("string"))))
    return derive(s, d, RAW).withColumns({"freqs": F.array_repeat("frequency", n("n_freqs")), "media": media, "docs": docs})


FIRST = "arg_min({0}, q) FILTER ({1})"
add(
    "A2_A3_golden_fields",
    lambda s, d: golden.merge_fields(raw_fields(s, d)).select(
        "gid", "id", "name", "code", "country", "kind", "difficulty", "raw_difficulty", *golden.NUMBERS, "sources", "merged",
        F.concat_ws(",", F.transform(F.map_entries("docs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("docs"),
    ),
    f"""WITH r AS (SELECT *, upper(trim(code)) AS uc, upper(trim(difficulty)) AS ud, lower(source) AS low FROM ({plain(RAW)}) x),
    s AS (SELECT *, CASE WHEN low LIKE '%openaip%' THEN 40 ELSE 0 END + CASE WHEN low LIKE '%sia%' OR (n_media > 0 AND media_source LIKE 'SIA%') THEN 30 ELSE 0 END + CASE WHEN low LIKE '%guide%' OR low LIKE '%planeur-net%' THEN 20 ELSE 0 END AS sc,
      (code <> '')::int + (frequency <> '')::int + (lat IS NOT NULL)::int + (lon IS NOT NULL)::int + (elev_m IS NOT NULL)::int + (length_m IS NOT NULL)::int AS filled FROM r),
    t AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY sc DESC, filled DESC, n_freqs DESC, n_media DESC, (kind = 'airfield') DESC, src_seq) AS q,
      row_number() OVER (PARTITION BY gid ORDER BY (name = ''), (low LIKE '%openaip%') DESC, regexp_matches(shown, '(?i)\\bcair\\b'), regexp_matches(shown, '[0-9]'),
        CASE WHEN low LIKE '%openaip%' THEN 100 WHEN low LIKE '%sia%' THEN 90 WHEN low LIKE '%guide%' OR low LIKE '%planeur-net%' THEN 70 ELSE 0 END DESC, shown DESC) AS nq,
      row_number() OVER (PARTITION BY gid ORDER BY (uc = ''), NOT regexp_matches(uc, '^(LF|LS|LI)[A-Z0-9]{{2,4}}$'), length(uc), uc) AS cq FROM s),
    g AS (SELECT gid, arg_min(shown, nq) AS name, arg_min(uc, cq) AS code, {FIRST.format('country', "country <> ''")} AS country, CASE WHEN bool_or(kind = 'airfield') THEN 'airfield' ELSE 'outlanding' END AS kind,
      coalesce(max(ud) FILTER (ud IN ('A', 'B', 'C', 'D')), 'UNKNOWN') AS difficulty, arg_min(raw_difficulty, src_seq) FILTER (raw_difficulty <> '') AS raw,
      {', '.join(FIRST.format(c, c + ' IS NOT NULL') + ' AS ' + c for c in golden.NUMBERS)}, count(*) AS merged FROM t GROUP BY gid),
    n AS (SELECT gid, string_agg(source, ' + ' ORDER BY seq) AS sources FROM (SELECT gid, source, min(src_seq) AS seq FROM t GROUP BY gid, source) x GROUP BY gid),
    dd AS (SELECT gid, string_agg(doc || '=' || doc || '-' || last, ',' ORDER BY doc) AS docs FROM (SELECT gid, doc, max(src_seq) AS last FROM t WHERE doc IS NOT NULL GROUP BY gid, doc) x GROUP BY gid),
    o AS (SELECT * REPLACE (coalesce(country, CASE WHEN code LIKE 'LF%' THEN 'FR' WHEN code LIKE 'LS%' THEN 'CH' WHEN code LIKE 'LI%' THEN 'IT' ELSE '' END) AS country) FROM g)
    SELECT gid, coalesce(nullif(lower(country), ''), 'xx') || '_' || CASE WHEN regexp_matches(code, '^[A-Z0-9]{{3,5}}$') THEN lower(code) || '_' ELSE '' END || coalesce(nullif(replace(lower(name), ' ', '_'), ''), 'field')
      || '_' || replace(printf('%.4f', coalesce(lat, 0.0)), '.', 'p') || '_' || replace(printf('%.4f', coalesce(lon, 0.0)), '.', 'p') AS id, name, code, country, kind, difficulty, coalesce(raw, difficulty) AS raw_difficulty,
      {', '.join(golden.NUMBERS)}, sources, merged, coalesce(docs, '') AS docs FROM o JOIN n USING (gid) LEFT JOIN dd USING (gid)""",
)

#: Proposals in chains of four, 251 m apart, every fifth beside a site; the order of ids is not that of places.
PROPOSALS = f"""SELECT s_suppkey * 7919 % 1000003 AS contrib_id, CASE WHEN s_suppkey % 13 = 0 THEN ' ' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 5 = 0 THEN lat + cast(1 as double) / cast(1000 as double) ELSE 50 + floor(s_suppkey / 4) % 300 / cast(10 as double) + s_suppkey % 4 * 226 / cast(100000 as double) END AS lat,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN lon ELSE floor(s_suppkey / 1200) + cast(20 as double) END AS lon,
  CASE WHEN s_suppkey % 2 = 0 THEN 'field ' || {V('s_suppkey')} END AS field_id, CASE WHEN s_suppkey % 3 = 0 THEN 'airfield' ELSE 'meadow' END AS kind,
  CASE s_suppkey % 5 WHEN 1 THEN 'a' WHEN 2 THEN 'D' ELSE 'B' END AS difficulty, 'fr' AS country FROM (SELECT *, {fx._at('s_suppkey')} FROM {{supplier}}) p"""
CHAIN = f"""{S}, p AS ({plain(PROPOSALS)}), ok AS (SELECT *, row_number() OVER (ORDER BY contrib_id) AS rn FROM p WHERE trim(name) <> '' AND lat IS NOT NULL AND lon IS NOT NULL),
    h AS (SELECT contrib_id, src_seq, {hav('p.lat', 'p.lon', 's.lat', 's.lon')} AS d FROM ok p JOIN sites s ON s.lat BETWEEN p.lat - 0.01 AND p.lat + 0.01),
    known AS (SELECT contrib_id, arg_max(src_seq, -d * 1000000000 + src_seq / 1000000000) AS src_seq, min(d) AS d FROM h WHERE d <= 300 GROUP BY contrib_id),
    o AS (SELECT ok.*, known.src_seq, known.d FROM ok LEFT JOIN known USING (contrib_id)),
    step(n, kept) AS (SELECT cast(0 as bigint), CAST([] AS STRUCT(id BIGINT, la DOUBLE, lo DOUBLE)[])
      UNION ALL SELECT o.rn, CASE WHEN o.src_seq IS NOT NULL OR len(list_filter(kept, lambda k: {hav('k.la', 'k.lo', 'o.lat', 'o.lon')} <= 300)) > 0 THEN kept ELSE list_append(kept, {{'id': o.contrib_id, 'la': o.lat, 'lo': o.lon}}) END
      FROM step JOIN o ON o.rn = step.n + 1),
    made AS (SELECT unnest(kept, recursive := true) FROM step WHERE n = (SELECT max(n) FROM step)),
    m AS (SELECT contrib_id, arg_min(id, d) AS first_id, min(d) AS md FROM (SELECT contrib_id, id, {hav('ok.lat', 'ok.lon', 'la', 'lo')} AS d FROM ok JOIN made ON id < contrib_id) x WHERE d <= 300 GROUP BY contrib_id),
    f AS (SELECT p.*, k.src_seq, first_id, CASE WHEN ok.contrib_id IS NULL THEN 'bad' WHEN md IS NOT NULL AND (k.d IS NULL OR md <= k.d) THEN 'again' WHEN k.d IS NOT NULL THEN 'update' ELSE 'new' END AS how
      FROM p LEFT JOIN ok USING (contrib_id) LEFT JOIN known k USING (contrib_id) LEFT JOIN m USING (contrib_id))"""
add(
    "C1_triage_proposals",
    # of equally near proposals the SQL's arg_min keeps the first
    lambda s, d: contributions.triage_proposals(derive(s, d, PROPOSALS), sites(s, d), first=True),
    f"""{CHAIN} SELECT contrib_id, how, CASE WHEN how = 'update' THEN src_seq END AS src_seq, CASE WHEN how = 'again' THEN first_id END AS first_id,
    CASE WHEN how = 'new' THEN replace(replace(lower(coalesce(field_id, name)), ' ', '_'), '#', '_') || '-' || substr(sha1(printf('%.4f,%.4f', lat, lon)), 1, 6) END AS id,
    CASE WHEN how = 'new' THEN CASE WHEN kind = 'airfield' THEN 'airfield' ELSE 'outlanding' END END AS kind, CASE WHEN how = 'new' THEN CASE upper(difficulty) WHEN 'D' THEN 'UNKNOWN' ELSE upper(difficulty) END END AS difficulty,
    CASE WHEN how = 'new' THEN 'FR' END AS country FROM f""",
)

REPORTS = f"""SELECT o_orderkey AS contrib_id, 'contributions/' || {V('o_orderkey')} || '.json' AS path, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS src_seq,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE cast(cast(o_orderdate as date) as varchar(10)) END AS date, cast(cast(o_orderdate as date) as varchar(10)) || 'T10:00:00Z' AS submitted_at,
  CASE WHEN o_orderkey % 4 = 0 THEN 'pilot' || {V('o_orderkey % 9')} ELSE '' END AS handle, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE 'report ' || {V('o_orderkey % 40')} END AS description FROM {{orders}}"""
OWN = f"SELECT c_custkey AS src_seq, CASE WHEN c_custkey % 5 = 0 THEN 'fr' ELSE 'en' END AS lang, 'own note ' || {V('c_custkey % 20')} AS note FROM {{customer}}"
SAID = f"SELECT DISTINCT 'fr' AS lang, 'report ' || {V('o_orderkey % 40')} AS text, 'avis ' || {V('o_orderkey % 40')} AS translation FROM {{orders}} WHERE o_orderkey % 40 < 30"


def folded(s, d):
    notes, left = contributions.fold_contributions(derive(s, d, REPORTS), derive(s, d, OWN), derive(s, d, SAID))
    reject = left.select(F.lit(None).cast("long").alias("src_seq"), F.lit("rejected").alias("lang"), F.col("path").alias("note"), F.lit(0).cast("long").alias("added"))
    return notes.unionByName(reject)


add(
    "C2_fold_contributions",
    folded,
    f"""WITH r AS ({plain(REPORTS)}), l AS (SELECT * FROM (VALUES ('en', 'Pilot report'), ('fr', 'Rapport pilote'), ('de', 'Pilotenbericht')) v(lang, head)),
    x AS (SELECT src_seq, lang, path, head || ' ' || CASE WHEN date = '' THEN substr(submitted_at, 1, 10) ELSE date END || CASE WHEN handle <> '' THEN ' (' || handle || ')' ELSE '' END || ': '
      || CASE WHEN lang = 'fr' AND contrib_id % 40 < 30 THEN replace(description, 'report', 'avis') ELSE description END AS line FROM r, l WHERE src_seq IS NOT NULL AND trim(description) <> ''),
    g AS (SELECT src_seq, lang, string_agg(line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY path) AS note, count(*) AS added FROM x GROUP BY src_seq, lang)
    SELECT g.src_seq, g.lang, CASE WHEN o.note IS NULL THEN g.note ELSE o.note || chr(10) || chr(10) || '---' || chr(10) || chr(10) || g.note END AS note, added FROM g LEFT JOIN ({plain(OWN)}) o ON o.src_seq = g.src_seq AND o.lang = g.lang
    UNION ALL SELECT NULL, 'rejected', path, 0 FROM r WHERE src_seq IS NULL""",
)


def streamed(s, d):
    """The picks of every fix, which come as a stream."""
    events = f"{d}/events.parquet"
    out = f"{checkpoint_folder(s)}/answers-{uuid4().hex}"
    # a glob, as a stream reads folders and patterns only; the table may be either, a file or a folder
    fixes = read_fixes(s, f"{d}/events.parque[t]", s.read.parquet(events).schema)
    where = derive(s, d, fx.SITES)

    def answer(batch):
        placed = batch.sparkSession.sql(fx.FIXES.replace("{events}", "{batch}"), batch=batch)
        picks = answers.best_picks(where, placed)
        return picks.select("fix_id", "src_seq", "pick", F.round("ratio", 3).alias("ratio"), F.round("distance_m").cast("long").alias("d_m"))

    stream_answers(fixes, answer, f"{out}/rows", f"{out}/log").awaitTermination()
    return read_answers(s, f"{out}/rows")


add("X2_S13_stream_answers", streamed, site_plans.ORACLES["W2_top_picks"])

#: Notes with two frequencies, one with a label near it, and one that is none.
TALK = f"""SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'Tower TWR ' WHEN 1 THEN 'calls on ' ELSE 'afis or a/a: ' END || '12' || {V('p_partkey % 10')} || ',' || {V('100 + p_partkey % 900')}
  || ' and then, a good way further on in the same note, ' || '119.5 MHz; 138.100; 121.5000' AS note FROM {{part}}"""
add(
    "F13_labelled_frequencies",
    lambda s, d: derive(s, d, TALK).select("k", F.explode(text.labelled_frequencies(C("note"))).alias("f")).select("k", F.col("f.mhz").alias("mhz"), F.col("f.type").alias("type")),
    """SELECT p_partkey AS k, cast('12' || p_partkey % 10 || '.' || 100 + p_partkey % 900 as double) AS mhz, CASE p_partkey % 3 WHEN 0 THEN 'TWR' WHEN 1 THEN '' ELSE 'AFIS' END AS type FROM part
    UNION ALL SELECT p_partkey, 119.5, '' FROM part""",
)
PLACES = f"SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'lfx' WHEN 1 THEN 'LSZ' WHEN 2 THEN 'GCX' WHEN 3 THEN 'EDM' WHEN 4 THEN 'LIP' ELSE 'LF' END || {V('c_custkey % 10')} AS code FROM {{customer}}"
add(
    "F8_country_from_icao",
    lambda s, d: derive(s, d, PLACES).select("k", text.country_from_icao(C("code")).alias("country"), text.is_country_icao(C("code"), ["FR", "CH"]).alias("wanted")),
    f"""SELECT k, CASE WHEN upper(code) LIKE 'LF%' THEN 'FR' WHEN code LIKE 'LS%' THEN 'CH' WHEN code LIKE 'LI%' THEN 'IT' WHEN code LIKE 'GC%' THEN 'ES' ELSE '' END AS country,
    length(code) = 4 AND (upper(code) LIKE 'LF%' OR code LIKE 'LS%') AS wanted FROM ({plain(PLACES)}) x""",
)
STRIPS = f"SELECT p_partkey AS k, {V('400 + p_partkey % 300')} || ' m x ' || {V('p_size')} || ' m / ' || {V('400 + p_partkey * 7 % 300')} || ' m' AS strips FROM {{part}}"
add(
    "F23_longest_strip",
    lambda s, d: derive(s, d, STRIPS).select("k", text.longest_strip(C("strips")).alias("x")).select("k", "x.length_m", "x.width_m"),
    """SELECT p_partkey AS k, cast(greatest(400 + p_partkey % 300, 400 + p_partkey * 7 % 300) as double) AS length_m, CASE WHEN p_partkey % 300 >= p_partkey * 7 % 300 THEN cast(p_size as double) END AS width_m FROM part""",
)
add(
    "F24_rewrite_phrases",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.rewrite_phrases(C("text"), [("[0-9]+", "#"), ("#[.,]#", "%")], "[aeiou][0-9 ]|#")).alias("digest")),
    """SELECT doc_id, md5(CASE WHEN regexp_matches(text, '(?i)[aeiou][0-9 ]|#') THEN regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '#[.,]#', '%', 'g') ELSE text END) AS digest FROM documents""",
)
CHARTS = f"""SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_partkey % 4 WHEN 0 THEN 'docs/vac/A' || {V('l_partkey % 50')} || '.pdf' WHEN 1 THEN '../_shared/docs/vac/B.PDF' WHEN 2 THEN 'https://x.org/media/' || {V('l_partkey')} || '.jpg' ELSE 'media/c.jpg' END AS url,
  CASE WHEN l_partkey % 3 = 0 THEN 'thumbs/d.jpg' END AS thumbnail_url FROM {{lineitem}}"""
add(
    "F32_chart_keys",
    lambda s, d: derive(s, d, CHARTS)
    .select("k", text.share_media_urls(text.stamp_chart_keys(F.array(F.struct("url", "thumbnail_url")), "dev/"))[0].alias("m"))
    .select("k", "m.url", "m.thumbnail_url", "m.chart_key"),
    f"""SELECT k, CASE WHEN url LIKE '%://%' OR url LIKE '../_shared/%' THEN url ELSE '../_shared/' || url END AS url, '../_shared/' || thumbnail_url AS thumbnail_url,
    CASE WHEN url LIKE '%docs/vac/%' THEN 'dev/' || regexp_extract(url, 'docs/(.*)$', 1) END AS chart_key FROM ({plain(CHARTS)}) x""",
)
add(
    "F34_airac_window",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select(C("o_orderkey").alias("k"), F.posexplode(records.airac_dates(F.date_add(F.to_date("o_orderdate"), 10_000))).alias("place", "day")).select("k", F.col("place").cast("long").alias("place"), "day"),
    """WITH o AS (SELECT o_orderkey AS k, cast(o_orderdate as date) + 10000 AS t FROM orders), c AS (SELECT cast(DATE '2024-01-25' + cast(i * 28 as int) as date) AS day FROM range(1000) r(i))
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY abs(day - t), day) - 1 AS place, day FROM o JOIN c ON day BETWEEN t - 365 AND t + 56""",
)
add(
    "G3_G4_tiles_and_cells",
    lambda s, d: sites(s, d).select("src_seq", geo.parse_tile_key(geo.tile_key(C("lat"), C("lon"))).alias("t"), geo.cell_centre(F.floor((90 - C("lat")) * 1200), F.floor((C("lon") + 180) * 1200)).alias("c"), geo.tiles_for_bounds(C("lat") - 0.6, C("lon") - 0.6, C("lat") + 0.6, C("lon") + 0.6).alias("k"))
    .select("src_seq", F.col("t.lat0").cast("long").alias("lat0"), F.col("t.lon0").cast("long").alias("lon0"), F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"), F.size("k").cast("long").alias("tiles"), F.col("k")[0].alias("first")),
    f"""{S} SELECT src_seq, cast(ceil(lat) - 1 as bigint) AS lat0, cast(floor(lon) as bigint) AS lon0, round(90 - (floor((90 - lat) * 1200) + 0.5) / 1200, 6) AS lat, round((floor((lon + 180) * 1200) + 0.5) / 1200 - 180, 6) AS lon,
    cast((ceil(lat + 0.6) - ceil(lat - 0.6) + 1) * (floor(lon + 0.6) - floor(lon - 0.6) + 1) as bigint) AS tiles, printf('N%02dE%03d', cast(ceil(lat - 0.6) - 1 as int), cast(floor(lon - 0.6) as int)) AS first FROM sites""",
)
add(
    "G7_profile_lines",
    lambda s, d: sites(s, d).select("src_seq", F.explode(geo.profile_lines(F.array(C("elev_m"), F.lit(None), C("elev_m") + 100), F.lit(500.0), F.lit(2500.0), F.lit(20.0), F.lit(150.0))).alias("x")).select("src_seq", "x.at_m", "x.ground", "x.envelope", "x.glide"),
    f"""{S}, i AS (SELECT unnest([0, 1, 2]) AS i) SELECT src_seq, i * 500.0::double AS at_m, CASE i WHEN 0 THEN elev_m WHEN 2 THEN elev_m + 100 END AS ground, CASE i WHEN 0 THEN elev_m + 150 WHEN 2 THEN elev_m + 250 END AS envelope, 2500 - i * 25.0::double AS glide FROM sites, i""",
)
add(
    "W11_unique_ids",
    lambda s, d: ops.unique_ids(s.read.parquet(f"{d}/orders.parquet").select(C("o_orderkey").alias("k"), F.concat(F.lit("site_"), C("o_custkey").cast("string")).alias("id")), "k"),
    "SELECT k, 'site_' || c || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS id FROM (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) x",
)
NODES = f"""SELECT event_id AS seq, CASE WHEN event_id % 6 = 0 THEN ' ' ELSE 'Col ' || {V('event_id % 100')} END AS name, 45 + user_id / cast(3000 as double) AS lat, CASE WHEN event_id % 11 <> 0 THEN 7 + event_id % 5 / cast(3000 as double) END AS lon,
  CASE event_id % 4 WHEN 0 THEN '2,' || {V('100 + event_id % 800')} WHEN 1 THEN {V('1000 + event_id % 800')} || ' m' WHEN 2 THEN 'high' END AS ele FROM {{events}}"""
add(
    "S11_cols",
    lambda s, d: files.read_cols(derive(s, d, NODES)),
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY round_even(lat * 2000, 0), round_even(lon * 2000, 0) ORDER BY seq) AS place FROM ({plain(NODES)}) x WHERE trim(name) <> '' AND lon IS NOT NULL)
    SELECT name, round_even(lat, 5) AS lat, round_even(lon, 5) AS lon, CASE seq % 4 WHEN 0 THEN 2100 + seq % 800 WHEN 1 THEN 1000 + seq % 800 END AS elev_m FROM n WHERE place = 1""",
)
