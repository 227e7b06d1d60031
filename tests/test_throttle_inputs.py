"""The throttle with settings as a second input: batch, stream over restarts, state that goes."""

import datetime as dt


from pyspark.sql import functions as F

from glidemesh.plans import streams as plans
from glidemesh.streaming import inputs
from tests.oracle import rows_of_duckdb, rows_of_spark

P = inputs.ThrottleParams(idle_s=600.0)
FIX = "session_id long, event_id long, ts timestamp, lat double, lon double, alt_m double"
SET = "session_id long, event_id long, ts timestamp, clearance_m double, margin_m double, sites double"
T0 = dt.datetime(2026, 1, 1, 12, tzinfo=dt.timezone.utc)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def fixes_and_settings():
    fixes = [(k, 10 * i + k, at(10 * i), 45 + i * 0.0008 * (k + 1), 7.0, 2000.0 + (90 if i > 20 and k == 2 else 0)) for k in range(3) for i in range(40)]
    fixes += [(1, 5_000 + i, at(2_000 + i), 45.03, 7.0, 2000.0) for i in range(3)]  # after a long silence
    fixes += [(0, 401, at(401), None, 7.0, 1.0)]
    settings = [(0, 3, at(3), 200.0, 250.0, 90.0), (1, 104, at(104), None, 300.0, None), (1, 105, at(105), None, 300.0, None), (2, 203, at(203), None, None, 91.0), (9, 1, at(0), 1.0, 1.0, 1.0)]
    return fixes, settings


def both(spark, fixes, settings):
    none = lambda *cs: [F.lit(None).cast("double").alias(c) for c in cs]
    a = spark.createDataFrame(fixes, FIX).select("session_id", "event_id", "ts", F.lit("fix").alias("kind"), "lat", "lon", "alt_m", *none("clearance_m", "margin_m", "sites"))
    b = spark.createDataFrame(settings, SET).select("session_id", "event_id", "ts", F.lit("settings").alias("kind"), *none("lat", "lon", "alt_m"), "clearance_m", "margin_m", "sites")
    return a.unionByName(b)


def test_why_events_are_emitted(spark):
    got = {(r.session_id, r.event_id): r.why for r in inputs.throttle_events(both(spark, *fixes_and_settings()), P).collect()}
    assert got[0, 0] == "first" and got[0, 3] == "settings" and (0, 401) not in got
    assert got[1, 104] == "settings" and (1, 105) not in got  # the same settings again
    assert got[2, 203] == "settings" and got[2, 212] == "moved"  # a climb of 90 m
    assert got[1, 5_000] == "first" and (1, 5_001) not in got
    assert not [k for k in got if k[0] == 9]  # settings without a position


def test_stream_over_restarts_equals_the_batch(spark, tmp_path):
    """Three runs of the query from one log; the settings change between the batches."""
    fixes, settings = fixes_and_settings()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = []
    try:
        for lo, hi in ((-1, 90), (90, 300), (300, 10_000)):
            for name, rows, schema in (("f", fixes, FIX), ("s", settings, SET)):
                part = [r for r in rows if at(lo) < r[2] <= at(hi)]
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            f, s = (spark.readStream.schema(x).parquet(f"{tmp_path}/{n}") for n, x in (("f", FIX), ("s", SET)))
            out = inputs.throttle_event_stream(f, s, P)
            keep = lambda b, _: found.extend(map(tuple, b.collect()))
            out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    want = [tuple(r) for r in inputs.throttle_events(both(spark, fixes, settings), P).collect()]
    assert sorted(found) == sorted(want) and len(want) > 20


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = rows_of_spark(plans.QUERIES["X1_throttle_inputs"](spark, sf))
    assert got == rows_of_duckdb(plans.SQL, sf) and {"first", "settings", "moved"} == {r[got[0].index("why")] for r in got[1]}
