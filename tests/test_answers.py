"""Bounded ranking against the ranking of all pairs."""

import random

import pytest

from glidemesh.operators import answers

COLS = ["fix_id", "src_seq", "rank", "ratio", "distance_m"]


def tables(spark, n=400, seed=2):
    rng = random.Random(seed)
    spots = [(rng.gauss(45, 0.3), rng.gauss(7, 0.3)) if i % 3 else (45.2, 7.1) for i in range(n)]  # a third at one place
    sites = [(i, *p, rng.choice(["airfield", "outlanding"]), rng.choice("ABCD"), rng.choice([None, 200.0, 900.0, 1700.0])) for i, p in enumerate(spots)]
    fixes = [(i, rng.uniform(43.8, 46.2), rng.uniform(5.8, 8.2), rng.choice([300.0, 460.0, 1000.0, 1800.0, 4000.0, None])) for i in range(150)] + [(999, None, 7.0, 2000.0)]
    make = spark.createDataFrame
    return make(sites, "src_seq long, lat double, lon double, kind string, difficulty string, elev_m double"), make(fixes, "fix_id long, lat double, lon double, alt_m double")


@pytest.mark.parametrize("k,radius", [(1, 60_000.0), (10, 60_000.0), (40, 25_000.0)])
def test_first_k_as_of_all_pairs(spark, k, radius):
    sites, fixes = tables(spark)
    want = answers.rank_answers(answers.score_pairs(sites, fixes, radius)).where(f"rank <= {k}").select(COLS)
    got = answers.best_answers(sites, fixes, k, radius).select(COLS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100


def test_no_sites_or_fixes(spark):
    sites, fixes = tables(spark)
    assert answers.best_answers(sites.limit(0), fixes, 5).count() == 0 and answers.best_answers(sites, fixes.limit(0), 5).count() == 0


def test_picks_rest_and_drift_from_the_best(spark):
    sites, fixes = tables(spark, 250, 5)
    sites = sites.where("elev_m is not null")
    fixes = fixes.where("alt_m > 400")
    scored = answers.score_pairs(sites, fixes)
    ranked, picks = answers.rank_answers(scored), answers.top_picks(scored)
    few, best = answers.best_picks(sites, fixes), answers.best_answers(sites, fixes, 33)
    cols = ["fix_id", "src_seq", "pick"]
    assert sorted(few.select(cols).collect()) == sorted(picks.select(cols).collect()) and few.count() > 50
    cols = ["fix_id", "src_seq", "place"]
    assert sorted(answers.rest_list(best, few, 30).select(cols).collect()) == sorted(answers.rest_list(ranked, picks, 30).select(cols).collect())
    far = answers.rank_answers(scored.where("distance_m > 20000"))
    want = sorted(answers.rank_drift(ranked, far, 10).collect())
    assert sorted(answers.drift_beyond(scored, 20_000.0, 10).collect()) == want
    assert sorted(answers.drift_beyond(answers.best_answers(sites, fixes, 10).drop("rank"), 20_000.0, 10).collect()) == want
