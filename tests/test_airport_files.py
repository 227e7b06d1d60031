"""Airport tables, JSON in several envelopes, snapshots of folders, and the throttle as a stream."""

import hashlib
import json

from pyspark.sql import functions as F

from glidemesh.sources import sites
from glidemesh.streaming import throttle
from glidemesh.streaming.answers import read_fixes


def test_json_envelopes(spark, tmp_path):
    a, b = {"name": "a", "geo": {"x": [1, 2]}}, {"name": "b"}
    for i, doc in enumerate([[a, 3, b], {"type": "FeatureCollection", "features": [a]}, {"items": [a, b]}, {"results": []}, {"name": "one"}]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    rows = sites.read_airport_json(spark, str(tmp_path)).collect()
    got = sorted((r.path[-6], json.loads(r.raw)["name"]) for r in rows)
    assert got == [("0", "a"), ("0", "b"), ("1", "a"), ("2", "a"), ("2", "b"), ("4", "one")]
    assert json.loads(next(r.raw for r in rows if r.path[-6] == "1")) == a


def test_csv_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,ident,name,latitude_deg,longitude_deg,elevation_ft,type,iso_country\n1,lfaa,"A, ""x""",45,6,1000,small,FR\n2,LFAB,,45,,,,\n3,KJFK,n,1,1,1,t,US\n4,LFAC,,46,7,,,\n')
    (tmp_path / "r.csv").write_text("id,airport_ident,length_ft,width_ft,le_ident,le_heading_degT\n1,LFAA,1000,50,07,70\n2,LFAA,2000,,12,\n3,LFAA,2000,60,13,130\n4,LFAA,,,,\n")
    (tmp_path / "f.csv").write_text("id,airport_ident,type,description,frequency_mhz\n1,LFAA,TWR,d,119.5\n2,LFAA,X,,140\n3,LFAA,Y,,abc\n")
    airports = {r.code: r for r in sites.read_airports(spark, f"{tmp_path}/a.csv", ["FR"]).collect()}
    assert sorted(airports) == ["LFAA", "LFAC"]
    assert (airports["LFAA"].name, airports["LFAA"].elev_m) == ('A, "x', 304.8)  # quotes at the ends of a value go
    assert (airports["LFAC"].name, airports["LFAC"].elev_m, airports["LFAC"].type, airports["LFAC"].country) == ("LFAC", None, "airport", "FR")
    (r,) = sites.read_runways(spark, f"{tmp_path}/r.csv", ["FR"]).collect()
    assert (r.code, r.length_m, r.width_m, r.heading_deg, r.runway) == ("LFAA", 609.6, None, None, "12")
    assert [tuple(x) for x in sites.read_frequencies(spark, f"{tmp_path}/f.csv", ["FR"]).collect()] == [("LFAA", 119.5, "TWR", "d")]


def test_snapshot(spark, tmp_path):
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "a.jpg").write_bytes(b"abc")
    (tmp_path / "b.pdf").write_bytes(b"")
    got = {r.path: (r.hash, r["size"]) for r in sites.snapshot_files(spark, str(tmp_path)).collect()}
    assert got == {"media/a.jpg": (hashlib.sha1(b"abc").hexdigest()[:16], 3)}  # the empty file is not listed


def test_throttle_as_a_stream_equals_the_batch(spark, tmp_path):
    """Two arrivals, one after the other: what the first left as its last fix holds in the second."""
    rows = spark.range(400).select(
        (F.col("id") % 3).alias("session_id"), F.col("id").alias("event_id"), (F.timestamp_seconds(F.col("id"))).alias("ts"),
        (45 + F.col("id") / 2000).alias("lat"), F.lit(7.0).alias("lon"), (2000 + F.col("id") * 29 % 120).cast("double").alias("alt_m"),
    )
    folder, log = f"{tmp_path}/in", f"{tmp_path}/log"
    found = []
    for part in (rows.where("event_id < 150"), rows.where("event_id >= 150")):
        part.coalesce(1).write.mode("append").parquet(folder)
        out = throttle.throttle_stream(read_fixes(spark, folder, rows.schema))

        def keep(batch, _):
            found.extend((r.session_id, r.event_id) for r in batch.collect())

        out.writeStream.foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    want = throttle.throttle_batch(rows.withColumn("n", F.col("event_id"))).collect()
    assert sorted(found) == sorted((r.session_id, r.event_id) for r in want) and 3 < len(want) < 400
