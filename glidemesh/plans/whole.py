"""Golden records with frequencies, media and notes, with their SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.operators import golden
from glidemesh.plans.golden import RAW, dealt
from glidemesh.sources.fixtures import plain

SEQ = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + l_orderkey * 1000"
#: What each record says of its place beside its fields: a frequency, a photo and a note.
_SAID = """cast(117.5 + l_partkey % 12 * 0.5 as double) AS mhz, CASE l_suppkey % 5 WHEN 0 THEN 'TWR' WHEN 1 THEN '' WHEN 2 THEN 'A/A' WHEN 3 THEN '7' ELSE 'INFO' END AS use,
  CASE l_partkey % 3 WHEN 0 THEN 'ATIS too' ELSE '' END AS description, CASE l_suppkey % 4 WHEN 0 THEN 'OpenAIP' WHEN 1 THEN 'Guide' WHEN 2 THEN 'SIA' ELSE '' END AS heard_from,
  CASE l_partkey % 8 WHEN 0 THEN '' ELSE 'u' || cast(l_partkey % 5 as varchar(20)) END AS url, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'note ' || cast(l_partkey % 3 as varchar(20)) END AS fr,
  CASE WHEN l_linenumber % 3 = 0 THEN 'text ' || cast(l_suppkey % 2 as varchar(20)) END AS en"""
SAID = f"SELECT {SEQ} AS src_seq, {_SAID} FROM {{lineitem}}"


def records(s, d):
    # what is said is read in the same pass: both number an order's lines alike, and a join by that
    # number would deal the records anew, away from their groups
    r = dealt(s, d, RAW, f", {_SAID}")
    freqs = F.array(F.struct("mhz", F.col("use").alias("type"), "description", F.col("heard_from").alias("source")))
    media = F.array(F.struct("url", F.col("media_source").alias("source")))
    docs = F.when(F.col("doc").isNotNull(), F.create_map("doc", "doc"))
    return r.withColumns({"freqs": freqs, "media": media, "docs": docs, "notes": F.create_map(F.lit("fr"), "fr", F.lit("en"), "en"), "frequency": F.lit("")})


def query(s, d):
    heard = F.array_join(F.transform("frequencies", lambda x: F.concat_ws(":", F.format_string("%.3f", x.mhz), x.type, x.source)), ",")
    return golden.whole_records(records(s, d)).select(
        "gid", "code", "merged", "frequency", heard.alias("frequencies"), F.array_join(F.transform("media", lambda x: x.url), ",").alias("media"), F.col("notes.fr").alias("fr"), F.col("notes.en").alias("en")
    )


RANK = "CASE " + " ".join(f"WHEN contains(said, '{t}') THEN {i}" for i, t in enumerate(golden.FREQ_ORDER)) + f" ELSE {len(golden.FREQ_ORDER)} END"
NOTE = "(SELECT gid, string_agg(note, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY first_at) AS {0} FROM (SELECT gid, {0} AS note, min(src_seq) AS first_at FROM r WHERE {0} <> '' GROUP BY ALL) x GROUP BY gid)"
SQL = f"""WITH r AS (SELECT *, lower(heard_from) AS low, upper(concat_ws(' ', use, description)) AS said FROM ({plain(RAW)}) a JOIN ({plain(SAID)}) b USING (src_seq)),
s AS (SELECT *, {RANK} AS rank, CASE WHEN low LIKE '%sia%' OR low LIKE '%aip%' THEN 50 ELSE 0 END + CASE WHEN low LIKE '%openaip%' THEN 40 ELSE 0 END + CASE WHEN low LIKE '%guide%' THEN 10 ELSE 0 END
  + CASE WHEN use <> '' THEN 2 ELSE 0 END + CASE WHEN description <> '' THEN 1 ELSE 0 END AS score FROM r),
f AS (SELECT *, printf('%.3f', mhz) AS heard FROM (SELECT *, row_number() OVER (PARTITION BY gid, mhz ORDER BY score DESC, src_seq) AS k FROM s) x WHERE k = 1),
l AS (SELECT gid, string_agg(heard || ':' || use || ':' || heard_from, ',' ORDER BY rank, mhz) AS frequencies, arg_min(heard || CASE WHEN use IN ('', '7') THEN '' ELSE ' ' || use END, (rank, mhz)) AS frequency FROM f GROUP BY gid),
m AS (SELECT gid, string_agg(url, ',' ORDER BY first_at) AS media FROM (SELECT gid, url, min(src_seq) AS first_at FROM r WHERE url <> '' GROUP BY ALL) x GROUP BY gid),
c AS (SELECT gid, count(*) AS merged, coalesce(arg_min(upper(trim(code)), (NOT regexp_matches(upper(trim(code)), '^(LF|LS|LI)[A-Z0-9]{{2,4}}$'), length(trim(code)), upper(trim(code)))) FILTER (trim(code) <> ''), '') AS code FROM r GROUP BY gid)
SELECT c.gid, code, merged, coalesce(frequency, '') AS frequency, coalesce(frequencies, '') AS frequencies, coalesce(media, '') AS media, fr, en
FROM c LEFT JOIN l USING (gid) LEFT JOIN m USING (gid) LEFT JOIN {NOTE.format('fr')} nf USING (gid) LEFT JOIN {NOTE.format('en')} ne USING (gid)"""

QUERIES = {"A2_A6_golden_records_whole": query}
ORACLES = {"A2_A6_golden_records_whole": SQL}
