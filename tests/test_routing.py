import heapq
import math
import time

import numpy as np
import pytest

from glidemesh.operators import reach
from glidemesh.operators import routing as rt
from glidemesh.plans import routing as plans
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"
P = rt.GlideParams()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, name):
    got, want = rows_of_spark(plans.QUERIES[name](spark, SF)), rows_of_duckdb(plans.ORACLES[name], SF)
    assert got[0] == want[0] and got[1] == want[1] and got[1]


def room(elev, floor, alt, cell, flown):
    if cell in floor:
        return alt - floor[cell]
    if cell not in elev:
        return -1.0
    return alt - elev[cell] - P.clearance_m * min(1.0, flown / P.ramp_m)


def search(elev, floor, origin, alt, dy, dx, ratio, size):
    dist, heap, done = {origin: 0.0}, [(0.0, origin)], set()
    while heap:
        d, at = heapq.heappop(heap)
        if at in done:
            continue
        done.add(at)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                to = (at[0] + i, at[1] + j)
                if (not i and not j) or not (0 <= to[0] < size and 0 <= to[1] < size) or to in done:
                    continue
                way = d + math.hypot(i * dy, j * dx)
                h = room(elev, floor, alt, to, way)
                if h > 0 and way <= ratio * h and way < dist.get(to, math.inf):
                    dist[to] = way
                    heapq.heappush(heap, (way, to))
    return dist


@pytest.fixture(scope="module")
def world(spark):
    rng, n = np.random.default_rng(3), 22
    cells, solves, targets = [], [], []
    for k in range(4):
        hill = rng.integers(300, 700, size=(n, n))
        hill[9:11, :] += 1200
        hill[9:11, 4 + 3 * k : 6 + 3 * k] -= 1200
        cells += [(k, int(r), int(c), int(hill[r, c])) for r in range(n) for c in range(n) if rng.random() > 0.03]
        solves.append((k, 17, 3 + 4 * k, 1500.0 + 100 * k, 278.0, 240.0))
        targets += [(k, 100 * k + i, int(rng.integers(0, n)), int(rng.integers(0, n)), 500.0) for i in range(12)]
    make = spark.createDataFrame
    return cells, solves, targets, make(cells, "solve_id long, r long, c long, elev int"), make(solves, "solve_id long, r0 long, c0 long, alt_m double, north_m double, east_m double"), make(targets, "solve_id long, target_id long, r long, c long, elev_m double")


def test_reachability_against_a_search_by_distance(world):
    cells, solves, targets, *dfs = world
    got = {r.target_id: r for r in rt.reachability(*dfs).collect()}
    want = {}
    for k, r0, c0, alt, dy, dx in solves:
        elev = {(r, c): e for s, r, c, e in cells if s == k}
        mine = [t for t in targets if t[0] == k]
        floor = {}
        for _, _, r, c, e in mine:
            floor[r, c] = min(floor.get((r, c), math.inf), e + P.margin_m)
        for ratio in P.ladder:
            dist = search(elev, floor, (r0, c0), alt, dy, dx, ratio, 22)
            for _, t, r, c, _ in mine:
                if t not in want and (r, c) in dist:
                    want[t] = (ratio, dist[r, c])
    assert set(got) == set(want) and len(want) > 15
    for t, (ratio, length) in want.items():
        assert got[t].rung == ratio and got[t].length_m == pytest.approx(length)
        steps = list(zip(got[t].nodes, got[t].nodes[1:]))
        assert all(max(abs(a.r - b.r), abs(a.c - b.c)) == 1 for a, b in steps)


def test_routes_are_never_worse_than_grid_path_or_line(world):
    _, solves, targets, grid, s, t = world
    reach = rt.reachability(grid, s, t)
    raw = {r.target_id: r for r in rt.score_paths(reach.select("solve_id", "target_id", "nodes"), grid, s, t).collect()}
    lines = rt.score_paths(rt.direct_lines(s, t), grid, s, t)
    straight = {r.target_id: r.ratio for r in lines.collect()}
    fine = rt.refine_paths(reach, grid, s, t)
    refined = {r.target_id: r for r in fine.collect()}
    assert set(refined) == {k for k, r in raw.items() if r.ratio is not None}
    assert all(r.ratio <= raw[k].ratio and len(r.nodes) <= len(raw[k].nodes) for k, r in refined.items())
    assert any(len(r.nodes) < len(raw[k].nodes) for k, r in refined.items())
    for r in rt.choose_routes(fine, lines).collect():
        both = [x for x in (straight[r.target_id], refined[r.target_id].ratio if r.target_id in refined else None) if x is not None]
        assert r.ratio == min(both) and r.direct == (straight[r.target_id] == min(both)) and r.direct_ratio == straight[r.target_id]


def test_profile_bins_hold_the_highest_sample(spark, world):
    cells, solves, targets, grid, s, t = world
    paths = rt.direct_lines(s, t)
    elev = {(k, r, c): e for k, r, c, e in cells}
    geo = {x[0]: x for x in solves}
    for row in rt.profiles(paths, grid, s, 16).collect():
        k, r0, c0, _, dy, dx = geo[row.solve_id]
        _, _, r1, c1, _ = next(x for x in targets if x[1] == row.target_id)
        n, length = max(abs(r1 - r0), abs(c1 - c0)), math.hypot((r1 - r0) * dy, (c1 - c0) * dx)
        walked = [(length * i / n, elev.get((k, math.floor(r0 + (r1 - r0) * i / n + 0.5), math.floor(c0 + (c1 - c0) * i / n + 0.5)))) for i in range(n + 1)]
        step, want, at = walked[-1][0] / 15, [], 0
        for i in range(16):
            while at < len(walked) - 1 and walked[at + 1][0] < i * step:
                at += 1
            span = [walked[at][1]] + [e for d, e in walked[at:] if d <= i * step + step]
            want.append(max((e for e in span if e is not None), default=None))
        assert row.length_m == pytest.approx(length) and sum(a != b for a, b in zip(row.terrain, want)) <= 1


def test_unknown_ground_and_empty_tables(spark, world):
    *_, grid, s, t = world
    none = rt.score_paths(rt.direct_lines(s, t), grid.limit(0), s, t).where("ratio is not null")
    assert none.where("size(nodes) > 1 and nodes[0] <> nodes[1] and length_m > 400").count() == 0
    assert rt.reachability(grid.limit(0), s, t).count() == 0 and rt.reachability(grid, s, t.limit(0)).count() == 0


@pytest.mark.parametrize("side", [5, 8, 22])
def test_tiles_do_not_change_labels_or_rungs(world, side):
    """Windows cut into tiles, with paths that leave a tile and come back, against one tile each."""
    _, _, _, *dfs = world
    whole = {r.target_id: r for r in rt.reachability(*dfs).collect()}
    cut = {r.target_id: r for r in rt.reachability(*dfs, side=side).collect()}
    assert set(cut) == set(whole)
    for t, r in cut.items():
        assert (r.rung, r.length_m, len(r.nodes)) == (whole[t].rung, pytest.approx(whole[t].length_m), len(whole[t].nodes))
        assert (r.nodes[0], r.nodes[-1]) == (whole[t].nodes[0], whole[t].nodes[-1])
        assert all(max(abs(a.r - b.r), abs(a.c - b.c)) == 1 for a, b in zip(r.nodes, r.nodes[1:]))


def hills(n, seed=0):
    rng, y = np.random.default_rng(seed), np.arange(n)
    ground = np.full((n + 4, n + 4), np.nan)
    ground[2:-2, 2:-2] = 900 + 500 * np.sin(y / 9)[:, None] + 450 * np.cos(y / 7)[None, :] + rng.normal(0, 60, (n, n))
    return reach.Ground(ground, np.full(ground.shape, np.nan), 3000.0, 278.0, 250.0)


@pytest.mark.parametrize("n,seconds", [(230, 4.0), (650, 30.0)])
def test_ladder_within_the_published_times(n, seconds):
    """Twelve rungs over the windows of 32 and 90 km."""
    ground = hills(n)
    dist = np.full((len(P.ladder), ground.elev.size), np.inf)
    dist[:, (n // 2) * ground.elev.shape[1] + n // 2] = 0.0
    start = time.perf_counter()
    reach.settle_ladder(dist, ground, P)
    assert time.perf_counter() - start < seconds
    assert (np.isfinite(dist).sum(axis=1)[1:] >= np.isfinite(dist).sum(axis=1)[:-1]).all() and np.isfinite(dist[-1]).sum() > n * n / 4


def test_labels_are_a_fixpoint_of_the_search_by_distance():
    ground = hills(60, 4)
    dist = np.full((len(P.ladder), ground.elev.size), np.inf)
    origin = 30 * 64 + 30
    dist[:, origin] = 0.0
    reach.settle_ladder(dist, ground, P)
    elev = {(r, c): ground.elev[r, c] for r in range(64) for c in range(64) if not np.isnan(ground.elev[r, c])}
    for k, ratio in enumerate(P.ladder):
        want = search(elev, {}, (30, 30), ground.alt_m, ground.north_m, ground.east_m, ratio, 64)
        got = {(int(i) // 64, int(i) % 64): dist[k, i] for i in np.flatnonzero(np.isfinite(dist[k]))}
        assert set(got) == set(want) and all(got[c] == pytest.approx(d) for c, d in want.items())


def test_all_paths_of_a_window_are_pulled_at_once(world):
    """Against one path at a time; before, each path's legs were walked apart, as often as paths share them."""
    cells, solves, targets, grid, s, t = world
    scored = rt.score_paths(rt.reachability(grid, s, t), grid, s, t).where("ratio is not null")
    got = {r.target_id: [tuple(n) for n in r.nodes] for r in rt.pull_strings(scored, grid, s, t).collect()}
    paths, by_id, geo = scored.collect(), {x[1]: x for x in targets}, {x[0]: x for x in solves}

    def needs(k, a, b, flown, arrives):
        n, out, (_, _, _, alt, dy, dx) = max(abs(b[0] - a[0]), abs(b[1] - a[1])), [], geo[k]
        way = flown + math.hypot((b[0] - a[0]) * dy, (b[1] - a[1]) * dx)
        elev = {(r, c): e for q, r, c, e in cells if q == k}
        floor = {}
        for q, _, r, c, e in targets:
            if q == k:
                floor[r, c] = min(floor.get((r, c), math.inf), e + P.margin_m)
        for i in range(1, n + (not arrives)):
            cell = tuple(math.floor(u + (v - u) * i / n + 0.5) for u, v in zip(a, b))
            here = flown + (way - flown) * i / n
            h = room(elev, floor, alt, cell, here)
            out.append(here / h if h > 0 else math.inf)
        return max(out, default=-math.inf), way

    assert len(got) == len(paths) > 15 and any(len(got[r.target_id]) < len(r.nodes) for r in paths)
    for r in paths:
        nodes, at, flown, kept = [tuple(n) for n in r.nodes], 0, 0.0, [tuple(r.nodes[0])]
        while at < len(nodes) - 1:
            to = at + 1
            while to < len(nodes) - 1 and needs(r.solve_id, nodes[at], nodes[to + 1], flown, to + 1 == len(nodes) - 1)[0] <= r.ratio:
                to += 1
            flown, at = needs(r.solve_id, nodes[at], nodes[to], flown, False)[1], to
            kept.append(nodes[at])
        assert got[r.target_id] == kept and kept[-1] == by_id[r.target_id][2:4]


def test_legs_that_paths_share_are_walked_once(monkeypatch):
    """One hundred targets beside each other, with one path: before, its legs were walked for each of them."""
    asked = []
    part = rt.pa.RecordBatch.from_arrays([rt.pa.array([0] * 100), rt.pa.array(range(100)), rt.pa.array([[{"r": i, "c": 0} for i in range(9)]] * 100), rt.pa.array([50.0] * 100)], names=["solve_id", "target_id", "nodes", "ratio"])
    needed = rt._needed
    monkeypatch.setattr(rt, "_needed", lambda *a: (asked.append(len(a[3])), needed(*a))[1])
    flat = np.zeros((10, 2))
    got = rt._pulled(flat, np.full((10, 2), np.nan), {"alt_m": 2000.0, "north_m": 100.0, "east_m": 100.0}, part, P, part.schema)
    assert got[2].to_pylist() == [[{"r": 0, "c": 0}, {"r": 8, "c": 0}]] * 100 and sum(asked) == 7
