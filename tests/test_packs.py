import hashlib
import random

import pytest

from glidemesh.operators import packs


def inside(lat, lon, ring):
    odd = False
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def rings():
    rng = random.Random(5)
    star = [(45 + rng.uniform(-2, 2), 7 + rng.uniform(-3, 3)) for _ in range(25)]  # crosses itself
    return {1: [(44.0, 6.0), (46.0, 6.0), (46.0, 9.0), (44.0, 9.0)], 2: star, 3: [(-1.3, -0.7), (0.4, 0.9), (1.1, -0.2)], 4: [(45.01, 7.01), (45.02, 7.02), (45.01, 7.03)]}


@pytest.fixture(scope="module")
def tables(spark):
    rng, shape = random.Random(6), rings()
    spots = [(rng.uniform(42, 48), rng.uniform(3, 11)) for _ in range(600)] + [(rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(200)]
    spots += [v for ring in shape.values() for v in ring] + [(44.0, 7.0), (46.0, 7.0), (45.0, 6.0), (45.0, 9.0), (44.5, 6.25), (45.015, 7.02)]
    spots += [(y, x) for y in (44.25, 45.0, 45.75) for x in (6.5, 7.0, 8.75)]
    sites = [(i, y, x, "FR" if i % 3 else None) for i, (y, x) in enumerate(spots)] + [(-1, None, 7.0, "FR"), (-2, 45.0, None, None)]
    edges = [(f, *a, *b) for f, ring in shape.items() for a, b in zip(ring, ring[1:] + ring[:1])]
    make = spark.createDataFrame
    return spots, make(sites, "src_seq long, lat double, lon double, country string"), make([(f, float(a), float(b), float(c), float(d)) for f, a, b, c, d in edges], "fence int, y1 double, x1 double, y2 double, x2 double")


@pytest.mark.parametrize("cell", [0.25, 0.1, 3.0])
def test_rings_as_ray_casting(tables, cell):
    spots, sites, edges = tables
    got = sorted((r.src_seq, r.fence) for r in packs.in_fences(sites, edges, cell).collect())
    assert got == sorted((i, f) for i, (y, x) in enumerate(spots) for f, ring in rings().items() if inside(y, x, ring))


def test_bands_overlap_and_no_nested_loop(spark, tables):
    spots, sites, edges = tables
    rows = [("west", 1, None, 1, None, 7.5), ("east", 2, None, 1, 7.0, None), ("fr", 3, "FR", None, None, None), ("both", 4, "FR", 2, None, None)]
    p = spark.createDataFrame(rows, "pack_id string, pack_rank int, country string, fence int, min_lon double, max_lon double")
    out = packs.assign_packs(sites, p, edges)
    got = {}
    for r in out.collect():
        got.setdefault(r.pack_id, []).append(r.src_seq)
    in1 = [i for i, (y, x) in enumerate(spots) if inside(y, x, rings()[1])]
    assert sorted(got["west"]) == [i for i in in1 if spots[i][1] <= 7.5] and sorted(got["east"]) == [i for i in in1 if spots[i][1] >= 7.0]
    assert set(got["west"]) & set(got["east"]) and -1 in got["fr"]
    fr = set(got["fr"])
    assert sorted(got["both"]) == sorted(fr | {i for i, (y, x) in enumerate(spots) if inside(y, x, rings()[2])})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fingerprints_of_groups(spark):
    rows = [(g, i * 7 % 50, f"{i:032x}" if i % 5 else None) for g in (None, 1, 2) for i in range(40 * (g or 1))]
    df = spark.createDataFrame(rows, "dir int, path long, hash string").repartition(6)
    got = {r.dir: r.digest for r in packs.fingerprint(df, "dir").collect()}
    line = lambda p, h: ":".join([str(p)] + ([h[:12]] if h else []))
    assert got == {g: hashlib.sha256("\n".join(sorted(line(p, h) for k, p, h in rows if k == g)).encode()).hexdigest() for g in (None, 1, 2)}
    assert "collect_list" not in packs.fingerprint(df, "dir")._jdf.queryExecution().optimizedPlan().toString()
    assert packs.fingerprint(df.limit(0), "dir").count() == 0
