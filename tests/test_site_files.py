from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.sources import sites

HEAD = "name,code,country,lat,lon,elev,style,rwdir,rwlen,freq,desc,userdata,pics"


def test_waypoint_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [
        '"Champ, ""du"" haut",LFXX,FR,4530.000N,00630.000E,1200m,4,090,600m,123.5,"Pente {difficile} 400 x 25",,"a.jpg;b.txt"',
        ",X,FR,4530.000N,00630.000E,,,,,,,,",
        '"No place",,FR,bad,00630.000E,,,,,,,,',
        '"Field 2",,IT,4400.600S,00700.000W,3281ft,5,,,,plain,,',
    ]
    (tmp_path / "in" / "a.cup").write_text("﻿" + HEAD + '"version=1",,,\r\n' + "\r\n".join(rows), encoding="utf-8")
    (tmp_path / "in" / "b.cup").write_bytes((HEAD + "\nChâteau,,FR,4500.000N,00600.000E,,,,,,,,\n").encode("latin-1"))
    got = {r.name: r for r in sites.read_waypoints(spark, f"file://{tmp_path}/in", "guide").collect()}
    assert set(got) == {'Champ, "du" haut', "Field 2", "Château"}
    a, b = got['Champ, "du" haut'], got["Field 2"]
    assert (a.lat, a.lon, a.elev_m, a.length_m, a.width_m, a.heading_deg) == (45.5, 6.5, 1200.0, 600.0, 25.0, 90.0)
    assert (a.raw_difficulty, a.difficulty, a.kind, a.notes, a.media_refs) == ("difficile", "C", "airfield", "Pente 400 x 25", ["a.jpg"])
    assert (b.lat, b.lon, b.elev_m, b.difficulty, b.kind, b.source) == (-44.01, -7.0, 1000.0, "A", "airfield", "guide")


def test_waypoints_written_are_read_back(spark, tmp_path):
    rows = [("p", "airfield", '#3 The "Field"', "LFAB", "FR", 45.5, 6.5, 1000.0, 90.0, 700.0, "123.500", "[A] · grass"), ("q", "outlanding", "Low", "FR_X_45P1_6P2", "FR", -1.25, -70.5, None, None, None, None, None), ("q", "outlanding", "Nowhere", "", "FR", None, 1.0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "pack_id string, kind string, name string, code string, country string, lat double, lon double, elev_m double, heading_deg double, length_m double, frequency string, description string")
    lines = sites.waypoint_lines(df)
    sites.write_waypoints(lines, f"file://{tmp_path}/out")
    back = [r.value for r in spark.read.text(f"file://{tmp_path}/out/pack_id=p").collect()]
    assert back == ['"The ""Field""","LFAB",FR,4530.000N,00630.000E,1000m,5,90,700m,123.500,"[A] · grass"']
    assert [r.line for r in lines.where("pack_id = 'q'").collect()] == ['"Low","",FR,0115.000S,07030.000W,,3,,,,""']
    sites.write_packs(df.withColumn("src_seq", F.monotonically_increasing_id()), f"file://{tmp_path}/packs")
    assert spark.read.json(f"file://{tmp_path}/packs").count() == 3


def test_names_and_submissions(spark, tmp_path):
    names = {"#12 LFMR BARCELONNETTE": "Barcelonnette", "saint jean DE maurienne": "Saint Jean de Maurienne", "Aspres-Sued LFNJ": "Aspres-Sud", "LFMR": "Lfmr", "McDonald la ferme": "McDonald la Ferme"}
    df = spark.createDataFrame(list(names.items()), "a string, b string").select("a", "b", text.clean_display_name(F.col("a")).alias("c"))
    assert {r.a: r.c for r in df.collect()} == names
    rows = [("new-field", "ab", "45", "6", "FR", None, None, 0), ("new-field", "abc", "", "6", "FR", None, None, 0), ("new-field", "abc", "45", "6", "ES", None, None, 0), ("new-field", " abc ", "45", "6", "fr", None, None, 9), ("new-field", "abc", "45", "6", "fr", None, None, 1), ("update", None, "1", "2", None, "id", " ", 0), ("update", None, "1", None, None, "id", "x", 0), ("update", None, "1", "2", None, "id", "x", None)]
    good, bad = sites.check_submissions(spark.createDataFrame(rows, "type string, name string, lat string, lon string, country string, site_id string, description string, photos int"))
    assert sorted(r.reason for r in bad.collect()) == ["coordinates", "country", "empty", "name", "photos", "reference"]
    assert sorted((r.type, r.name, r.lat, r.country) for r in good.collect()) == [("new-field", "abc", 45.0, "FR"), ("update", "", 1.0, None)]
    (tmp_path / "c" / "x").mkdir(parents=True)
    (tmp_path / "c" / "x" / "1.json").write_text('{"fieldId": "a", "fieldLat": 45.5,\n "description": "ok"}')
    (tmp_path / "c" / "2.json").write_text('{"broken')
    found, broken = sites.read_contributions(spark, f"file://{tmp_path}/c")
    assert [(r.site_id, r.lat, r.description) for r in found.collect()] == [("a", 45.5, "ok")] and broken.count() == 1
