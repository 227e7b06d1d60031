"""The throttle with two inputs as a batch, with its SQL twin; the stream is compared with it in the tests."""

from __future__ import annotations

from glidemesh.sources.fixtures import derive, plain
from glidemesh.streaming import inputs

#: Every event is a fix, but each 17th is a change of the site count or of the clearance.
EVENTS = """SELECT user_id AS session_id, event_id, ts, CASE WHEN event_id % 17 = 0 THEN 'settings' ELSE 'fix' END AS kind,
  CASE WHEN event_id % 17 <> 0 THEN 45 + user_id % 100 / cast(100 as double) + event_id % 1000 / cast(200000 as double) END AS lat,
  CASE WHEN event_id % 17 <> 0 AND event_id % 50 <> 1 THEN cast(7 as double) END AS lon, CASE WHEN event_id % 17 <> 0 THEN cast(2000 + event_id * 29 % 120 as double) END AS alt_m,
  CASE WHEN event_id % 34 = 0 THEN cast(150 + event_id % 3 * 50 as double) END AS clearance_m, cast(null as double) AS margin_m,
  CASE WHEN event_id % 34 = 17 THEN cast(event_id % 2 as double) END AS sites FROM {events}"""
PARAMS = inputs.ThrottleParams(idle_s=86_400.0)

MOVED = """abs(ha - qa) >= 75 OR 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(hl) - radians(ql)) / 2), 2) + cos(radians(ql)) * cos(radians(hl)) * pow(sin((radians(ho) - radians(qo)) / 2), 2)))) >= 400"""
SQL = f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM ({plain(EVENTS)}) e),
w AS (SELECT session_id, cast(null as bigint) AS event_id, cast(0 as bigint) AS n, min(ts) AS seen, cast(null as double) AS hl, cast(null as double) AS ho, cast(null as double) AS ha, cast(null as double) AS c, cast(null as double) AS s,
    cast(null as double) AS ql, cast(null as double) AS qo, cast(null as double) AS qa, cast(null as double) AS wc, cast(null as double) AS ws, cast(null as varchar) AS why FROM t GROUP BY session_id
  UNION ALL SELECT session_id, event_id, n, seen, hl, ho, ha, c, s, CASE WHEN why IS NULL THEN ql ELSE hl END, CASE WHEN why IS NULL THEN qo ELSE ho END, CASE WHEN why IS NULL THEN qa ELSE ha END,
    CASE WHEN why IS NULL THEN wc ELSE c END, CASE WHEN why IS NULL THEN ws ELSE s END, why
  FROM (SELECT *, CASE WHEN hl IS NULL OR skip THEN NULL WHEN ql IS NULL THEN 'first' WHEN c IS DISTINCT FROM wc OR s IS DISTINCT FROM ws THEN 'settings' WHEN {MOVED} THEN 'moved' END AS why
    FROM (SELECT session_id, event_id, n, seen, skip, CASE WHEN fix THEN lat ELSE hl END AS hl, CASE WHEN fix THEN lon ELSE ho END AS ho, CASE WHEN fix THEN alt_m ELSE ha END AS ha,
        coalesce(clearance_m, c) AS c, coalesce(sites, s) AS s, ql, qo, qa, wc, ws
      FROM (SELECT t.session_id, t.event_id, t.n, t.ts AS seen, t.lat, t.lon, t.alt_m, t.clearance_m, t.sites, t.kind = 'fix' AND t.lon IS NOT NULL AS fix, t.kind = 'fix' AND t.lon IS NULL AS skip,
          CASE WHEN i THEN NULL ELSE hl END AS hl, CASE WHEN i THEN NULL ELSE ho END AS ho, CASE WHEN i THEN NULL ELSE ha END AS ha, CASE WHEN i THEN NULL ELSE c END AS c, CASE WHEN i THEN NULL ELSE s END AS s,
          CASE WHEN i THEN NULL ELSE ql END AS ql, CASE WHEN i THEN NULL ELSE qo END AS qo, CASE WHEN i THEN NULL ELSE qa END AS qa, CASE WHEN i THEN NULL ELSE wc END AS wc, CASE WHEN i THEN NULL ELSE ws END AS ws
        FROM (SELECT w.* EXCLUDE (event_id, n, seen, why), t.*, epoch(t.ts) - epoch(w.seen) > 86400 AS i FROM w JOIN t ON t.session_id = w.session_id AND t.n = w.n + 1) t) y) x) z)
SELECT session_id, event_id, why FROM w WHERE why IS NOT NULL"""

QUERIES = {"X1_throttle_inputs": lambda s, d: inputs.throttle_events(derive(s, d, EVENTS), PARAMS)}
ORACLES = {"X1_throttle_inputs": SQL}
