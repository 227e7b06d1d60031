"""Candidates, pending codes and airfields with their lists, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.operators import candidates as ops
from glidemesh.plans import records, sites
from glidemesh.sources import fixtures as fx
from glidemesh.sources.fixtures import derive, plain

QUERIES, ORACLES = {}, {}


def add(name, fn, sql):
    QUERIES[name] = fn
    ORACLES[name] = sql


RAW = f"SELECT k, raw, CASE WHEN k % 6 = 0 THEN ' lf' || substr('abcdefghij', cast(k % 9 as int) + 1, 2) ELSE '' END AS code FROM ({records.RECORDS}) r"
KNOWN = "SELECT 'LF' || substr('ABCDEFGHIJ', cast(c_custkey % 5 as int) + 1, 2) AS code FROM {customer} UNION ALL SELECT '' FROM {customer}"
RULE = """(CASE WHEN {own} THEN '{name}' WHEN k % 6 = 0 AND k % 9 < 5 THEN 'known' END)"""
GLIDER = "lower(raw) LIKE '%segelflug%' OR coalesce(try_cast(json_extract_string(raw, '$.type') as int), try_cast(json_extract_string(raw, '$.properties.type') as int)) IN (1, 12)"
for mode, own in (("all", "true"), ("glider", GLIDER), ("pack", "false")):
    rule = RULE.format(own=own, name="all" if mode == "all" else "relevant")
    add(
        f"P1_candidates_{mode}",
        lambda s, d, mode=mode: ops.pick_candidates(derive(s, d, RAW), derive(s, d, KNOWN), mode, [1, 12]).select("k", "why"),
        f"SELECT k, {rule} AS why FROM ({plain(RAW).replace('{{', '{').replace('}}', '}')}) x WHERE {rule} IS NOT NULL",
    )

DOCS = f"SELECT src_seq FROM ({fx.SITES_A}) s WHERE src_seq % 4 <> 0"
ONLY = "SELECT code FROM (" + fx.AIRPORTS + ") a WHERE src_seq % 2 = 0"
add(
    "J4_pending_codes",
    lambda s, d: ops.pending_codes(sites.sites(s, d), derive(s, d, DOCS), derive(s, d, ONLY)),
    f"""{sites.S}, docs AS ({plain(DOCS)}) SELECT code, count(*) AS sites, count(*) FILTER (d.src_seq IS NULL) AS without FROM sites s LEFT JOIN (SELECT DISTINCT src_seq FROM docs) d USING (src_seq)
    WHERE code <> '' AND code IN (SELECT code FROM ({plain(ONLY)}) o) GROUP BY code HAVING count(*) FILTER (d.src_seq IS NULL) > 0""",
)
FLAGGED = f"SELECT code, CASE WHEN src_seq % 3 = 0 THEN false WHEN src_seq % 3 = 1 THEN true END AS candidate FROM ({fx.AIRPORTS}) a"
EXTRA = "SELECT 'lfz' || substr('ABCDEFGHIJ', cast(p_partkey % 10 as int) + 1, 1) AS code FROM {part}"
add(
    "J4_probe_codes",
    lambda s, d: ops.probe_codes(sites.sites(s, d), derive(s, d, EXTRA), derive(s, d, FLAGGED), "LF[A-Z]{2}"),
    f"""{sites.S} SELECT DISTINCT code FROM (SELECT code FROM sites UNION ALL SELECT upper(code) FROM ({plain(EXTRA)}) e UNION ALL SELECT code FROM ({plain(FLAGGED)}) a WHERE candidate IS DISTINCT FROM false) x WHERE regexp_full_match(code, 'LF[A-Z]{{2}}')""",
)
add(
    "J2_airfields_with_lists",
    lambda s, d: ops.make_airfields(derive(s, d, fx.AIRPORTS), derive(s, d, fx.RUNWAYS), derive(s, d, fx.FREQS)).select(
        "src_seq", "length_m", "heading", F.size("frequencies").cast("long").alias("n"), F.array_join(F.transform("frequencies", lambda x: F.concat(F.format_string("%.3f", x.mhz), F.lit(":"), x.type.cast("string"))), ",").alias("heard")
    ),
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY airport ORDER BY length_m DESC, src_seq) AS n FROM ({plain(fx.RUNWAYS)}) x),
    f AS (SELECT airport, round(mhz, 3) AS mhz, min((src_seq, type)) AS f FROM ({plain(fx.FREQS)}) y WHERE mhz BETWEEN 118 AND 137 GROUP BY 1, 2),
    l AS (SELECT airport, count(*) AS n, string_agg(printf('%.3f', mhz) || ':' || cast(f[2] as varchar), ',' ORDER BY f, mhz) AS heard FROM f GROUP BY 1)
    SELECT a.src_seq, r.length_m, r.heading, coalesce(l.n, 0) AS n, coalesce(heard, '') AS heard FROM ({plain(fx.AIRPORTS)}) a LEFT JOIN r ON r.airport = a.src_seq AND r.n = 1 LEFT JOIN l ON l.airport = a.src_seq""",
)
