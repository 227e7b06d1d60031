"""Golden records, contributions, streams and small functions against their SQL and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.operators import contributions
from glidemesh.plans import golden
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(golden.QUERIES))
def test_query_equals_sql(spark, name):
    got, want = rows_of_spark(golden.QUERIES[name](spark, SF)), rows_of_duckdb(golden.ORACLES[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]


def metres(a, b):
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * asin(min(1, sqrt(h)))


def test_first_come_equals_brute_force_in_a_crowd(spark):
    rng = random.Random(3)
    points = [(i, 45 + rng.random() / 50, 7 + rng.random() / 50) for i in rng.sample(range(10_000), 300)]
    points += [(20_000 + i, *points[i % 3][1:]) for i in range(50)]  # copies
    kept = []
    for p in sorted(points):
        if all(metres(p[1:], q[1:]) > 300 for q in kept):
            kept.append(p)
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    assert sorted(r.id for r in contributions.first_come(df, 300.0).collect()) == [p[0] for p in kept]
    assert contributions.first_come(df.limit(0), 300.0).collect() == []


def test_photos(spark):
    rows = [
        (1, "contributions/x/0 7.json", 5, "2026-01-02", "", "ann", [("a b.JPG", "https://u/1"), (None, "https://u/2"), ("c", "")]),
        (2, "p", None, "", "2026-02-03T1", None, [("d", "https://u/3")]),
    ]
    c = spark.createDataFrame(rows, "contrib_id long, path string, src_seq long, date string, submitted_at string, handle string, photos array<struct<name string, url string>>")
    s = spark.createDataFrame([(5, "site5")], "src_seq long, site_id string")
    out = contributions.contributed_photos(c, s).orderBy("path", "place").collect()
    assert [r.url for r in out] == ["media/site5/contrib-a_b.jpg", "media/site5/contrib-0_7.jpg"]
    assert out[0].caption == "Pilot photo · 2026-01-02 (ann)"


def test_proposal_note(spark):
    row = "45.5D lat, 7.25D lon, 'airfield' kind, 'b' difficulty, '07/25' runway, 600D length, cast(null as double) width, ' ' surface, '123.5' frequency, 450.5D elev"
    df = spark.sql(f"select {row}")
    note = df.select(contributions.proposal_note(*map(F.col, df.columns)).alias("n")).first().n
    assert note == "@45.50000, 7.25000 · airfield · difficulty B · Direction: 07/25 · 600 m · 123.5 · elev 450 m"


def test_extract_record(spark):
    page = """E12 / CHAMPS – SEO D’URGELL
  Altitude : 800 m               photo of the field
  Position : N 42° 20,5’ – W 1° 24,25’
  Orientation : 070° / 250°
  Longueur : 600 m x 50 m / 950 m x 20 m
  État surface : herbe   rase
  Observations : LESU - Fréq. = 119,800 MHz. Ligne
  au sud.

  Other text"""
    df = spark.createDataFrame([(page,), ("no heading",), (None,), ("",)], "t string")
    r, *rest = [x.r for x in df.select(text.extract_record(F.col("t")).alias("r")).collect()]
    assert rest == [None, None, None]
    assert (r.id, r.type, r.name, r.code, r.elev_m, list(r.directions)) == ("E12", "CHAMPS", "SEO D’URGELL", "LESU", 800, [70, 250])
    assert (round(r.lat, 6), round(r.lon, 6), r.length_m, r.width_m) == (round(42 + 20.5 / 60, 6), round(-1 - 24.25 / 60, 6), 950.0, 20.0)
    assert (r.surface, r.remarks) == ("herbe rase", "Ligne au sud.")
