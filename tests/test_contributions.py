"""Contributions from files to notes, and points decided in the order they come."""

import json
import random
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from glidemesh.operators import contributions as ops
from glidemesh.sources import sites


def metres(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * asin(min(1, sqrt(h)))


def brute(points, radius):
    kept = []
    for p in sorted(points):
        if all(metres(p[1:], q[1:]) > radius for q in kept):
            kept.append(p)
    return [p[0] for p in kept]


@pytest.mark.parametrize("tile_m", [400.0, 2_000.0, 32_000.0])
def test_decided_in_tiles_as_in_one_pass(spark, tile_m):
    rng = random.Random(8)
    points = [(45 + rng.random() / 20, 7 + rng.random() / 20) for _ in range(700)]
    points += [(89.999 - rng.random() / 300, rng.uniform(-180, 180)) for _ in range(60)] + [(rng.random() / 100, rng.choice([-1, 1]) * (180 - rng.random() / 100)) for _ in range(60)]
    points = [(i, *p) for i, p in zip(rng.sample(range(10_000), len(points)), points)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    assert sorted(r.id for r in ops.first_come(df, 300.0, tile_m).collect()) == brute(points, 300.0)


def test_a_chain_of_100_000_points(spark):
    """Each point hangs on the one before it, all round the globe: every second one is kept."""
    df = spark.range(100_000).select("id", F.lit(0.0).alias("lat"), (F.col("id") * 0.0018 - 90).alias("lon"))
    got = ops.first_come(df, 300.0)
    assert got.count() == 50_000 and got.where("id % 2 = 1").isEmpty()


def test_a_crowd_at_a_tile_edge_and_no_positions(spark):
    rows = [(i, 45.0 + (i % 97) * 1e-6, 7.0 + (i % 89) * 1e-6) for i in range(20_000)] + [(90_000, None, 7.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    assert [r.id for r in ops.first_come(df, 300.0, 500.0).collect()] == [0]


def test_files_to_notes(spark, tmp_path):
    """A proposal that falls on a site keeps its values in that site's note; one that is new makes a
    site, and a later one beside it becomes part of that."""
    new = lambda lat, lon, **more: {"type": "new-field", "proposed": {"name": "Alp", "latitude": lat, "longitude": lon, **more}, "submittedAt": "2026-03-04T10:00Z"}
    files = {
        "a/1.json": new(45.0, 7.001, surface="grass", lengthM=400, widthM="30", difficulty="b") | {"description": "flat", "submitter": {"handle": "ann"}},
        "b/2.json": new(46.0, 8.0, kind="airfield", country="ch") | {"fieldId": "alp-x", "description": "new one"},
        "b/3.json": new(46.001, 8.0, frequency="123.5") | {"photoAssets": [{"url": "https://u/1", "name": "p.jpg"}, {"url": ""}], "photoAsset": {"url": "https://u/2"}},
        "c/4.json": {"type": "update", "fieldId": "s1", "fieldLat": 45.0, "fieldLon": 7.0, "description": "wet", "date": "2026-05-06"},
        "c/5.json": [1, 2],
        "c/6.json": new(None, 8.0),
    }
    for name, v in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(v))
    read, broken = sites.read_contributions(spark, f"file://{tmp_path}")
    assert [r.path.rsplit("/", 1)[-1] for r in broken.collect()] == ["5.json"]
    contribs = ops.in_path_order(read)
    assert [r.path.rsplit("/", 1)[-1] for r in contribs.orderBy("contrib_id").collect()] == [f"{i}.json" for i in (1, 2, 3, 4, 6)]
    held = spark.createDataFrame([(11, "s1", 45.0, 7.0)], "src_seq long, site_id string, lat double, lon double")
    triaged = ops.triage_proposals(ops.proposals_of(contribs), held)
    names = contribs.select("contrib_id", F.substring_index("path", "/", -1).alias("file"))
    assert {r.file: r.how for r in triaged.join(names, "contrib_id").collect()} == {"1.json": "update", "2.json": "new", "3.json": "again", "6.json": "bad"}
    own = contribs.join(held.select("site_id", "src_seq"), "site_id", "left")
    folded = ops.fold_proposals(own, triaged)
    made = next(-1 - r.contrib_id for r in names.collect() if r.file == "2.json")
    none = spark.createDataFrame([], "src_seq long, lang string, note string")
    memory = spark.createDataFrame([], "lang string, text string, translation string")
    notes, left = ops.fold_contributions(folded, none, memory)
    got = {(r.src_seq, r.lang): r.note for r in notes.collect()}
    assert got[11, "en"].split("\n\n---\n\n") == [
        "Pilot report 2026-03-04 (ann): flat\nProposed field data: @45.00000, 7.00100 · difficulty B · 400×30 m · Surface: grass",
        "Pilot report 2026-05-06: wet",
    ]
    assert got[made, "fr"] == "Rapport pilote 2026-03-04: Proposed field data: @46.00100, 8.00000 · 123.5"
    assert set(k for k, _ in got) == {11, made} and [r.path.rsplit("/", 1)[-1] for r in left.collect()] == ["6.json"]
    photos = ops.contributed_photos(folded, spark.createDataFrame([(made, "alp-x")], "src_seq long, site_id string")).orderBy("place").collect()
    assert [r.url for r in photos] == ["media/alp-x/contrib-p.jpg", "media/alp-x/contrib-3.jpg"]
