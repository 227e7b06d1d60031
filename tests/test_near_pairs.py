import math
import random

import pytest
from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.operators import notes, packs, raster, resolve


def metres(a, b):
    x, y = math.radians(a[0]), math.radians(b[0])
    h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [800.0, 60_000.0, 2_500_000.0])
@pytest.mark.parametrize("spread", ["left", "right"])
def test_pairs_at_all_latitudes(spark, radius, spread):
    rng, deg = random.Random(4), math.degrees(radius / 6_371_000)
    pts = []
    for lat, lon in [(46, 7), (80, 20), (89.9995, 100), (-89.9, 0), (0, 180), (71.9, -180), (45, 179.9999), (90, 0)]:
        for _ in range(12):
            y = max(-90.0, min(90.0, lat + rng.uniform(-1.2, 1.2) * deg))
            x = lon + rng.uniform(-1.2, 1.2) * min(180, deg / max(0.001, math.cos(math.radians(y))))
            pts.append((len(pts), y, (x + 180) % 360 - 180))
    df = spark.createDataFrame([*pts, (999, None, 1.0)], "src_seq long, lat double, lon double")
    got = sorted((r.a, r.b) for r in resolve.near_pairs(df, df, radius, spread=spread).selectExpr("x.src_seq a", "y.src_seq b").collect())
    assert got == sorted((a[0], b[0]) for a in pts for b in pts if metres(a[1:], b[1:]) <= radius)


def test_line_over_ground_without_cells_has_no_ratio(spark):
    pair = spark.createDataFrame([(1, 0, 5, 0, 5, 3, 3000.0)], "pair long, tile long, r0 long, c0 long, r1 long, c1 long, alt double")
    cells = spark.createDataFrame([(0, 5, c, 500) for c in range(4)], "tile long, r long, c long, elev int")
    assert raster.direct_score(pair, cells).first().ratio is not None
    assert raster.direct_score(pair, cells.where("c <> 2")).first().ratio is None
    assert raster.direct_score(pair, cells.withColumn("elev", F.expr("if(c = 1, -32768, elev)"))).first().ratio is None
    long = raster.direct_score(pair, cells, cell_m=(278.0, 556.0)).first().ratio
    assert long > raster.direct_score(pair, cells, cell_m=278.0).first().ratio


def test_labels_folding_and_frequencies(spark):
    df = spark.createDataFrame([("121.5000 and 118,25 or 130.4", "Łódź Őrs Šibenik Çà é")], "t string, n string")
    row = df.select(text.mine_frequencies(F.col("t")).alias("f"), text.ascii_fold(F.col("n")).alias("n"), text.format_freq(F.lit(121.5), F.lit("N/A")).alias("x")).first()
    assert row.f == [118.25, 130.4] and row.n == "odz Ors Sibenik Ca e" and row.x == "121.500"


def test_pack_with_both_selectors_holds_a_site_once(spark):
    sites = spark.createDataFrame([(1, "FR", 45.0, 6.0), (2, "IT", 45.0, 6.5), (3, "FR", 10.0, 6.0)], "src_seq long, country string, lat double, lon double")
    pack = spark.createDataFrame([("p", 1, "FR", 1)], "pack_id string, pack_rank int, country string, fence int")
    ring = [(44.0, 5.0), (46.0, 5.0), (46.0, 7.0), (44.0, 7.0)]
    edges = spark.createDataFrame([(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], "fence int, y1 double, x1 double, y2 double, x2 double")
    assert sorted(r.src_seq for r in packs.assign_packs(sites, pack, edges).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        packs.assign_packs(sites, pack, edges, most=3)


def test_a_note_of_very_many_lines_stays_before_the_next(spark):
    many = "\n".join(f"line {i}" for i in range(100_050))
    df = spark.createDataFrame([(1, many), (2, "next")], "note_id long, text string")
    tm = spark.createDataFrame([], "norm string, translation string")
    got = notes.misses(df, tm, 10**9).collect()
    last = max(got, key=lambda r: r.total)
    assert len(got) == 100_051 and last.chars == 4


def test_stream_emits_what_the_batch_does(spark, tmp_path):
    from glidemesh.streaming import throttle

    rng, rows = random.Random(5), []
    for k in range(3):
        lat, alt = 45.0, 2000.0
        for n in range(60):
            lat, alt = lat + rng.uniform(0, 0.004), alt + rng.uniform(-60, 60)
            rows.append((k, 100 * k + n, n, n, lat, 7.0, alt))
    df = spark.createDataFrame(rows, "session_id long, event_id long, n long, ts long, lat double, lon double, alt_m double").coalesce(1)
    want = {r.event_id for r in throttle.throttle_batch(df).collect()}
    for part in (df.where("n < 25"), df.where("n >= 25")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = throttle.throttle_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert 10 < len(want) < 180 and got == want


def test_duplicate_links_join_what_all_pairs_join(spark):
    """Copies of strips and names, missing values and neighbours: the same groups from few links."""
    rng = random.Random(5)
    names = ["Alp", "Alp Nord", "Alp Sud", "", None, "Piste du Lac", "Lac", "12 Wiese", "Wiese"]
    rows = [
        (i, *rng.choice([(45.0, 7.0), (45.002, 7.0), (45.005, 7.001), (46.0, 8.0), (None, 7.0)]),
         rng.choice([None, 500.0, 512.0, 900.0, float("nan")]), rng.choice([None, 10.0, 190.0, 100.0]), rng.choice(names) if i % 3 else f"Feld {i}")
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, "src_seq long, lat double, lon double, elev_m double, heading_deg double, name string")

    def groups(links):
        label = {}
        for a, b in sorted(links.select("a", "b").collect()):
            old, new = sorted((label.setdefault(a, a), label.setdefault(b, b)), reverse=True)
            label = {k: new if g == old else g for k, g in label.items()}
        return label

    assert groups(resolve.duplicate_links(df)) == groups(resolve.duplicate_pairs(df))
    copies = spark.range(400).selectExpr("id as src_seq", "45D as lat", "7D as lon", "500D as elev_m", "10D as heading_deg", "'Alp' as name")
    assert resolve.duplicate_links(copies).count() == 2 * 399


def test_names_are_made_ready_in_all_tasks_and_words_seldom_compared(spark, monkeypatch):
    """Before, sites of one file were spread over 49 cells each by one task, and all neighbours' names were cut into words."""
    rng = random.Random(3)
    word = ["alp", "feld", "nord", "sud", "wiese", "see", "piste", "1", "2", "lac", "grand", "petit"]
    rows = [(i, 45 + rng.uniform(0, 0.01), 7 + rng.uniform(0, 0.01), rng.choice([None, 500.0, 900.0]), rng.choice([None, 10.0, 200.0]), " ".join(rng.sample(word, rng.randint(1, 5)))) for i in range(150)]
    df = spark.createDataFrame(rows, "src_seq long, lat double, lon double, elev_m double, heading_deg double, name string").coalesce(1)
    got = resolve.duplicate_pairs(df)
    x, y = (resolve._named(df).select(F.struct("*").alias(n)) for n in "xy")
    d = resolve.geo.haversine_m(*[F.col(f"{n}.{c}") for n in "xy" for c in ("lat", "lon")])
    each = x.crossJoin(y).withColumn("d", d).where("x.src_seq < y.src_seq and d <= 800")
    like = lambda s, t: text.token_jaccard(F.col(f"x.{s}"), F.col(f"y.{s}")) >= t
    for name, least in (("mn", 0.62), ("mb", 0.85)):
        assert each.where(resolve._alike(name, least) != like(name, least)).count() == 0
    want = each.where(F.coalesce(resolve.same_strip(), F.lit(False)) | resolve._same_name(resolve.DuplicateBounds()))
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((r.a, r.b) for r in want.selectExpr("x.src_seq a", "y.src_seq b").collect()) and got.count() > 100
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") >= 2
