"""The search by rings looks at few pairs, and leaves none out that counts."""

import random

import pytest
from pyspark.sql import functions as F

from glidemesh.operators import answers, contributions, resolve, rings
from glidemesh.plans import matching
from glidemesh.plans import sites as plans
from glidemesh.plans import subsets_all

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["W1_rank_answers", "W4_solve_targets", "W12_rank_drift", "W2_top_picks"])
def test_no_query_joins_pairs_on_cells(spark, monkeypatch, name):
    """Before, every one of them met all sites of a cell with all its fixes and sorted the pairs."""

    def all_pairs(*a, **k):
        raise AssertionError("pairs are scored one by one")

    monkeypatch.setattr(answers, "near_pairs", all_pairs)
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_a_crowd_at_one_place_and_all_round_the_globe(spark):
    rng = random.Random(3)
    at = [(46.0, 7.0)] * 3_000 + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(89.9, 10.0), (89.9, -170.0), (10.0, 180.0), (10.0, -179.9)]
    sites = spark.createDataFrame([(i, *p, "x", "A", 100.0) for i, p in enumerate(at)], "src_seq long, lat double, lon double, kind string, difficulty string, elev_m double")
    fixes = spark.createDataFrame([(0, 46.01, 7.0, 2000.0), (1, 89.95, 100.0, 2000.0), (2, 10.0, 179.95, 300.0), (3, -90.0, 0.0, None)], "fix_id long, lat double, lon double, alt_m double")
    few = rings.first_around(sites, fixes, 5, 60_000.0).where("p.fix_id = 0").select(F.size("near")).first()[0]
    assert few == 5
    cols = ["fix_id", "src_seq", "rank", "ratio", "distance_m"]
    want = answers.rank_answers(answers.score_pairs(sites, fixes)).where("rank <= 5").select(cols)
    assert sorted(map(str, answers.best_answers(sites, fixes, 5).select(cols).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name,plan", [("J6_nearest_within", plans), ("J7_name_cols", matching)])
def test_nearest_without_pairs_on_cells(spark, monkeypatch, name, plan):
    def all_pairs(*a, **k):
        raise AssertionError("pairs are compared one by one")

    monkeypatch.setattr(resolve, "near_pairs", all_pairs)
    assert plan.QUERIES[name](spark, SF).count() > 0


def test_nearest_ties_and_bounds(spark):
    sites = spark.createDataFrame([(1, 46.0, 7.0), (2, 46.0, 7.0), (3, 46.5, 7.0), (4, None, 7.0)], "src_seq long, lat double, lon double")
    points = spark.createDataFrame([(0, 46.001, 7.0), (1, 46.5, 7.0), (2, 10.0, 7.0), (3, None, 7.0)], "k long, lat double, lon double")
    got = lambda **more: {r.k: (r.site.src_seq, r.d_m) for r in resolve.nearest_within(points, sites, 1_000.0, "k", **more).collect()}
    assert got() == {0: (2, 111), 1: (3, 0)} and got(strict=True, first=True) == {0: (1, 111), 1: (3, 0)}
    assert resolve.nearest_within(points, sites.limit(0), 1_000.0, "k").count() == 0


def test_equally_near_proposals_as_in_sql(spark):
    """251.30053421726427 m to either side: before, the SQL's first came out as the last."""
    rows = [(1, "n", 59.40452, 24.0), (2, "n", 59.4, 24.0), (3, "n", 59.40226, 24.0)]
    more = "cast(null as string) field_id, 'x' kind, 'A' difficulty, 'fr' country"
    p = spark.createDataFrame(rows, "contrib_id long, name string, lat double, lon double").selectExpr("*", *more.split(", "))
    none = spark.createDataFrame([], "src_seq long, lat double, lon double")
    first = lambda **kw: {r.contrib_id: r.first_id for r in contributions.triage_proposals(p, none, **kw).collect()}[3]
    assert first(first=True) == 1 and first() == 2


@pytest.mark.parametrize("name,plan", [("W1_rank_answers_all", subsets_all), ("W3_rest_list", plans)])
def test_lists_are_ordered_in_a_fix_s_own_row(spark, name, plan):
    """Before, all pairs were sorted in a window, or joined to the picks and sorted by fix."""
    text = plan.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    after = text[: text.rindex("MapInArrow")]
    assert "Window" not in after and "Join" not in after


def test_fixes_and_sites_at_one_place_are_counted_once(spark):
    sites = spark.range(60).selectExpr("id AS src_seq", "45 + id % 3 / 10D AS lat", "7D AS lon", "CASE WHEN id % 5 = 0 THEN NULL ELSE 300D + id % 2 * 2000 END AS elev_m", "'airfield' AS kind", "CASE WHEN id % 4 = 0 THEN 'A' ELSE 'B' END AS difficulty")
    fixes = spark.range(40).selectExpr("id AS fix_id", "CASE WHEN id = 7 THEN NULL ELSE 45.05D END AS lat", "7D AS lon", "CASE WHEN id % 3 = 0 THEN NULL ELSE 2000D END AS alt_m")
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    scored = answers.score_pairs(sites, fixes)
    want = scored.groupBy("fix_id", "reason").agg(F.count("*").alias("n"), F.min("ratio").alias("best"))
    got = answers.count_answers(sites, fixes)
    assert rows(got, "fix_id", "reason", "n", "best") == rows(want, "fix_id", "reason", "n", "best")
    assert answers._places(fixes).count() == 2 and got.select("fix_id").distinct().count() == 39
    ranked = answers.rank_answers(scored)
    assert rows(answers.all_answers(sites, fixes), "fix_id", "src_seq", "rank", "ratio") == rows(ranked, "fix_id", "src_seq", "rank", "ratio")
    rest = answers.rest_list(ranked, answers.top_picks(scored), 10)
    assert rows(answers.rest_answers(sites, fixes, n=10), "fix_id", "src_seq", "place") == rows(rest, "fix_id", "src_seq", "place")


def test_lists_come_in_order_but_for_those_too_close_to_tell(spark):
    """Before, each list was measured, rated and sorted again after the search, and rings went through files."""
    rng = random.Random(8)
    rows = [(i, 45 + rng.randint(-400, 400) / 1000, 7 + rng.randint(-400, 400) / 1000, rng.choice([None, 300.0, 900.0, 1500.0])) for i in range(300)]
    rows += [(1000 + i, *rng.choice(rows)[1:]) for i in range(100)]  # copies, found out of order
    # one site on either side of a fix, equally far and high: which is nearer only the columns tell
    rows += [(2000, 10.0, 19.9, 300.0), (2001, 10.0, 20.1, 300.0), (None, 10.0, 20.2, 300.0), (2003, 10.0, 20.2, 300.0)]
    sites = spark.createDataFrame(rows, "src_seq long, lat double, lon double, elev_m double")
    at = [(i, 45 + rng.uniform(-0.5, 0.5), 7 + rng.uniform(-0.5, 0.5), rng.choice([None, 400.0, 1200.0, 2500.0])) for i in range(60)]
    fixes = spark.createDataFrame([*at, (900, 10.0, 20.0, 2000.0)], "fix_id long, lat double, lon double, alt_m double")
    with_kind = sites.selectExpr("*", "'x' kind", "'A' difficulty")
    scored = answers.rank_answers(answers.score_pairs(with_kind, fixes))
    for k in (7, 60, answers.EVERY):
        lists = rings.first_around(sites, fixes, k, 60_000.0, 250.0, ordered=True)
        got = {r.p.fix_id: ([y.src_seq for y in r.near], any(x.untold for x in r.parts)) for r in lists.collect()}
        want = {}
        for r in scored.where(f"rank <= {k}").orderBy("fix_id", "rank").collect():
            want.setdefault(r.fix_id, []).append(r.src_seq)
        sure = [f for f, (near, tied) in got.items() if not tied]
        assert got[900][1] and all(got[f][0] == want.get(f, []) for f in sure)
        assert len(sure) > 20 or k == answers.EVERY
        cols = ["fix_id", "src_seq", "rank", "ratio", "distance_m"]
        assert sorted(map(str, answers.best_answers(with_kind, fixes, k).select(cols).collect())) == sorted(map(str, scored.where(f"rank <= {k}").select(cols).collect()))


def test_fixes_at_one_place_share_the_search_for_targets(spark, monkeypatch):
    sites = spark.range(30).selectExpr("id AS src_seq", "45 + id / 100D AS lat", "7D AS lon", "CASE WHEN id % 5 = 0 THEN NULL ELSE 300D END AS elev_m", "'x' AS kind", "'A' AS difficulty")
    fixes = spark.range(50).selectExpr("CASE WHEN id = 3 THEN NULL ELSE id % 40 END AS fix_id", "45.05D AS lat", "7D AS lon", "CASE WHEN id % 3 = 0 THEN NULL ELSE 2000D END AS alt_m")
    asked, search = [], answers.first_around
    monkeypatch.setattr(answers, "first_around", lambda s, p, *a, **k: (asked.append(p.count()), search(s, p, *a, **k))[1])
    got = answers.targets_around(sites, fixes, 8)
    want = answers.solve_targets(answers.best_answers(sites, fixes, 8), 8)
    asked = asked[:1]
    assert asked == [2] and got.count() > 20 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rounded_as_by_decimal_numbers(spark):
    rng = random.Random(1)
    xs = [0.0005, 1.0005, 2.5, -0.0005, 1e12 + 0.5, 1.0004999999999999, None, float("nan"), *(rng.uniform(0, 1e4) for _ in range(2000)), *(i / 2000 for i in range(-50, 50))]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert df.where(~F.round("x", 3).eqNullSafe(answers._to_digits(F.col("x"), 3))).count() == 0
