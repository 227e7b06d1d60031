"""Landing-site tables derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Literals are whole numbers or cast to double, positions come from keys, and row order is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "nation")


def _at(k: str) -> str:
    return f"(43000 + {k} * 7919 % 4000) / cast(1000 as double) AS lat, (5000 + {k} * 104729 % 7000) / cast(1000 as double) AS lon"


def _code(k: str) -> str:
    return (
        f"CASE WHEN {k} % 3 = 0 AND {k} < 676 THEN 'LF' || chr(cast(65 + floor({k} / 26) % 26 as int)) || "
        f"chr(cast(65 + {k} % 26 as int)) ELSE '' END"
    )


SITES_A = f"""SELECT c_custkey AS src_seq, 'a' || cast(c_custkey as varchar(20)) AS site_id, {_at('c_custkey')},
  cast(300 + c_custkey * 31 % 1500 as double) AS elev_m,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(c_custkey * 37 % 36 * 10 as double) END AS heading_deg,
  cast(300 + c_custkey * 13 % 2400 as double) AS length_m,
  CASE c_custkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'UNKNOWN' END AS difficulty,
  CASE WHEN c_custkey % 4 = 0 THEN 'airfield' ELSE 'outlanding' END AS kind, {_code('c_custkey')} AS code, c_name AS name,
  CASE c_custkey % 6 WHEN 0 THEN 'FR' WHEN 1 THEN 'CH' WHEN 2 THEN 'DE' WHEN 3 THEN 'IT' WHEN 4 THEN 'AT' ELSE 'ES' END AS country,
  'guide' AS source FROM {{customer}}"""

SITES_B = """SELECT 10000000 + src_seq AS src_seq, 'b' || cast(src_seq as varchar(20)) AS site_id,
  lat + CASE WHEN src_seq % 35 = 0 THEN cast(5 as double) ELSE cast(1 as double) END / cast(1000 as double) AS lat, lon,
  elev_m + 5 AS elev_m, (cast(heading_deg as bigint) + 180) % 360 + cast(0 as double) AS heading_deg, length_m, difficulty, kind, '' AS code,
  CASE WHEN src_seq % 10 = 5 THEN 'Aerodrome ' || name ELSE 'STRIP ' || cast(src_seq as varchar(20)) END AS name,
  country, 'openaip' AS source FROM (""" + SITES_A + """) s WHERE src_seq % 5 = 0"""

SITES = f"{SITES_A} UNION ALL {SITES_B}"

#: The scoring fixes: every event.
FIXES = """SELECT event_id AS fix_id, (43000 + event_id * 613 % 4000) / cast(1000 as double) AS lat,
  (5000 + event_id * 811 % 7000) / cast(1000 as double) AS lon, cast(1500 + event_id * 17 % 2500 as double) AS alt_m
  FROM {events}"""

TRACK = """SELECT user_id AS session_id, event_id, n, 45 + user_id % 100 / cast(100 as double) + n / cast(1000 as double) AS lat,
  cast(7 as double) AS lon, cast(2000 + event_id * 29 % 120 as double) AS alt_m
  FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}) t"""

AIRPORTS = f"""SELECT s_suppkey AS src_seq, {_code('s_suppkey * 3')} AS code, {_at('s_suppkey')}, s_name AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'FR' WHEN 1 THEN 'DE' WHEN 2 THEN 'CH' ELSE 'IT' END AS country, s_suppkey % 7 AS type FROM {{supplier}}"""

RUNWAYS = """SELECT p_partkey AS src_seq, p_partkey % (SELECT count(*) FROM {supplier}) AS airport, p_size * 50 AS length_m,
  p_partkey % 36 * 10 AS heading FROM {part}"""

FREQS = """SELECT p_partkey AS src_seq, p_partkey % (SELECT count(*) FROM {supplier}) AS airport,
  110 + p_partkey * 25 % 30000 / cast(1000 as double) AS mhz, p_partkey % 11 AS type, p_name AS description FROM {part}"""

MEDIA = """SELECT l_orderkey % (SELECT count(*) FROM {customer}) AS site, l_partkey AS url, l_orderkey * 10 + l_linenumber AS pos,
  cast(floor(l_extendedprice) as bigint) AS bytes FROM {lineitem}"""

EDITIONS = """SELECT doc_id AS seq, doc_id % 80 AS code, doc_id % 3 AS slot, lang FROM {documents}"""

LOCAL = "SELECT doc_id AS path, md5(text) AS hash FROM {documents}"
REMOTE = """SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE md5(text) END AS hash FROM {documents} WHERE doc_id % 7 <> 0
  UNION ALL SELECT -1 - doc_id AS path, 'gone' AS hash FROM {documents} WHERE doc_id % 50 = 0"""

#: A raster tile for every customer block: rows and columns from key digits, so it grows with the table.
CELLS = """SELECT t.tile, r.i AS r, c.i AS c,
  CASE WHEN r.i = 5 AND c.i < 4 THEN -32768
       ELSE 600 + (r.i * 37 + c.i * 53 + t.tile * 11) % 97 + CASE WHEN r.i BETWEEN 22 AND 24 AND c.i NOT BETWEEN 30 AND 33 THEN 1500 ELSE 0 END END AS elev
  FROM (SELECT DISTINCT c_custkey % 1000 AS tile FROM {customer} WHERE c_custkey % 100 = 0) t
  JOIN (SELECT DISTINCT c_custkey % 48 AS i FROM {customer}) r ON t.tile >= 0 JOIN (SELECT DISTINCT c_custkey % 48 AS i FROM {customer}) c ON t.tile >= 0"""

PACKS = """SELECT 'north' AS pack_id, 1 AS pack_rank, cast(null as varchar(2)) AS country, cast(1 as int) AS fence
  UNION ALL SELECT 'south', 2, NULL, 2 UNION ALL SELECT 'france', 3, 'FR', NULL UNION ALL SELECT 'alps', 4, NULL, 3"""

#: Rings as edges (y1, x1) - (y2, x2); fixed values.
RINGS = {
    1: [(45, 5), (47, 5), (47, 12), (45, 12)],
    2: [(43, 5), (45, 5), (45, 12), (43, 12)],
    3: [(44, 6), (46, 6), (47, 8), (46, 11), (45, 9)],
}
EDGES = " UNION ALL ".join(
    f"SELECT {f} AS fence, cast({a[0]} as double) AS y1, cast({a[1]} as double) AS x1, cast({b[0]} as double) AS y2, cast({b[1]} as double) AS x2"
    for f, ring in RINGS.items()
    for a, b in zip(ring, ring[1:] + ring[:1])
)


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived table as a DataFrame."""
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in BASE if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same SQL over tables by name."""
    for n in BASE:
        sql = sql.replace("{" + n + "}", n)
    return sql
