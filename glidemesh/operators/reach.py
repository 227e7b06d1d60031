"""Reachability over elevation grids: least path lengths at each glide ratio of a ladder, and the paths.

Windows are cut into square tiles. A tile is settled by a bucket queue, its border labels go to the
tiles beside it, and the rounds go on until no label falls. So no task holds more than a tile,
however large a window is, and windows of one tile take one round.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glidemesh.operators.raster import NODATA
from glidemesh.operators.resolve import ensure_checkpoints

NODES = "array<struct<r:long,c:long>>"
TILE = ["solve_id", "tr", "tc"]
RIM = 2  # cells around a tile's own: labels of the tiles beside it, and a border that is never reached
MOVES = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


@dataclass(frozen=True)
class GlideParams:
    clearance_m: float = 200.0
    margin_m: float = 250.0
    ramp_m: float = 2_000.0
    #: Glide ratios that are tried from the lowest up. Fixed values.
    ladder: tuple[int, ...] = (8, 10, 12, 14, 17, 20, 24, 28, 33, 40, 50, 65)


def headroom(alt, elev, floor, flown, p: GlideParams):
    """Height left over cells; a cell that holds a target is bounded by its floor alone."""
    return np.where(np.isnan(floor), alt - elev - p.clearance_m * np.minimum(1.0, flown / p.ramp_m), alt - floor)


@dataclass(frozen=True)
class Ground:
    """One tile: heights and floors with a rim of cells that cannot be entered, and the glide over it."""

    elev: np.ndarray
    floor: np.ndarray
    alt_m: float
    north_m: float
    east_m: float

    @property
    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths of the eight moves, by rising offset."""
        offsets = np.array([i * self.elev.shape[1] + j for i, j in MOVES])
        lengths = np.array([float(np.hypot(i * self.north_m, j * self.east_m)) for i, j in MOVES])
        return offsets, lengths

    def enters(self, cells: np.ndarray, way: np.ndarray, ratio: float, p: GlideParams) -> np.ndarray:
        room = headroom(self.alt_m, self.elev.ravel()[cells], self.floor.ravel()[cells], way, p)
        with np.errstate(invalid="ignore"):
            return (room > 0) & (way <= ratio * room)


def settle(dist: np.ndarray, ground: Ground, ratio: float, p: GlideParams) -> None:
    """Lower the labels ``dist`` (flat, of the tile with its rim) to the least path lengths at a ratio.

    Labels that hold already, those of a lower ratio say, are kept: one sweep finds the cells that
    can be lowered or newly entered, and only from those the search goes on. Cells wait in buckets
    narrower than the shortest step, so what a bucket holds is final when its turn comes, and all of
    it is taken at once.
    """
    offsets, lengths = ground.steps
    width = lengths.min() * 0.999
    inner = np.flatnonzero(np.isfinite(ground.elev.ravel()) | np.isfinite(ground.floor.ravel()))
    if not len(inner) or not np.isfinite(dist).any():
        return
    buckets, turns = defaultdict(list), []

    def push(cells: np.ndarray) -> None:
        turn = (dist[cells] // width).astype(np.int64)
        for k in np.unique(turn).tolist():
            if k not in buckets:
                heapq.heappush(turns, k)
            buckets[k].append(cells[turn == k])

    way = np.full(len(inner), np.inf)
    for off, length in zip(offsets, lengths):
        np.minimum(way, dist[inner - off] + length, out=way)
    lower = np.flatnonzero(way < dist[inner])
    lower = lower[ground.enters(inner[lower], way[lower], ratio, p)]
    dist[inner[lower]] = way[lower]
    push(inner[lower])
    while turns:
        k = heapq.heappop(turns)
        cells = np.unique(np.concatenate(buckets.pop(k)))
        cells = cells[dist[cells] // width == k]
        to = (cells[:, None] + offsets).ravel()
        way = (dist[cells][:, None] + lengths).ravel()
        ok = np.flatnonzero(way < dist[to])
        to, way = to[ok], way[ok]
        ok = ground.enters(to, way, ratio, p)
        to, way = to[ok], way[ok]
        np.minimum.at(dist, to, way)
        push(np.unique(to))


def settle_ladder(dist: np.ndarray, ground: Ground, p: GlideParams) -> None:
    """``settle`` for each row of ``dist``, a ratio of the ladder; what a lower one reaches, a higher one does too."""
    for k, ratio in enumerate(p.ladder):
        if k:
            np.minimum(dist[k], dist[k - 1], out=dist[k])
        settle(dist[k], ground, ratio, p)


def entered_from(dist: np.ndarray, ground: Ground) -> np.ndarray:
    """The cell each cell's label comes from, -1 where there is none; of several the lowest."""
    offsets, lengths = ground.steps
    prev = np.full(len(dist), -1)
    inner = np.flatnonzero(np.isfinite(dist) & _own(ground.elev.shape).ravel())
    for off, length in zip(offsets[::-1], lengths[::-1]):  # greatest offset back: the lowest cell first
        fits = (prev[inner] < 0) & (dist[inner - off] + length == dist[inner])
        prev[inner[fits]] = inner[fits] - off
    return prev


def _own(shape: tuple[int, int]) -> np.ndarray:
    own = np.zeros(shape, bool)
    own[RIM:-RIM, RIM:-RIM] = True
    return own


def tiles(grid: DataFrame, solves: DataFrame, targets: DataFrame, p: GlideParams, side: int) -> DataFrame:
    """``(solve_id, tr, tc, rows, elev, floor)``: windows that hold a known cell and a target, cut into
    tiles of ``side`` cells and packed as doubles, NaN where there is no height or no floor."""
    known = grid.where(F.col("elev") != NODATA)
    asked = solves.join(targets.select("solve_id").distinct(), "solve_id", "left_semi").join(known.select("solve_id").distinct(), "solve_id", "left_semi")
    none = F.lit(None).cast("double")
    cells = known.select("solve_id", "r", "c", F.col("elev").cast("double").alias("elev"), none.alias("floor"))
    floors = targets.select("solve_id", "r", "c", none.alias("elev"), (F.col("elev_m") + p.margin_m).cast("double").alias("floor"))
    origins = asked.select("solve_id", F.col("r0").alias("r"), F.col("c0").alias("c"), none.alias("elev"), none.alias("floor"))
    every = cells.unionByName(floors).join(asked.select("solve_id"), "solve_id", "left_semi").unionByName(origins)
    every = every.withColumns({"tr": F.floor(F.col("r") / side), "tc": F.floor(F.col("c") / side)})

    def pack(key, x: pd.DataFrame) -> pd.DataFrame:
        r, c = (x[a].to_numpy(int) - k * side + RIM for a, k in zip(("r", "c"), key[1:]))
        shape = (r.max() + 1 + RIM, c.max() + 1 + RIM)
        elev, floor = np.full(shape, np.nan), np.full(shape, np.nan)
        seen = x.elev.notna().to_numpy()
        elev[r[seen], c[seen]] = x.elev[seen]
        np.fmin.at(floor, (r, c), x.floor.to_numpy(float))
        return pd.DataFrame([(*key, shape[0], elev.tobytes(), floor.tobytes())])

    packed = every.groupBy(*TILE).applyInPandas(pack, "solve_id long, tr long, tc long, rows int, elev binary, floor binary")
    return packed.join(asked.select("solve_id", "alt_m", "north_m", "east_m"), "solve_id")


def _ground(x) -> Ground:
    shape = (x.rows, -1)
    return Ground(np.frombuffer(x.elev).reshape(shape), np.frombuffer(x.floor).reshape(shape), x.alt_m, x.north_m, x.east_m)


LABELS = "solve_id long, tr long, tc long, dist binary, rung int, r long, c long, label double"


def _round(packed: DataFrame, state: DataFrame | None, news: DataFrame, p: GlideParams, side: int) -> DataFrame:
    """Settle the tiles that have news: their labels as one row each (``dist``), and a row for every
    border label that fell and every tile beside it."""

    def run(key, tile: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        if not len(tile):
            return pd.DataFrame(columns=["solve_id", "tr", "tc", "dist", "rung", "r", "c", "label"])
        x = next(tile.itertuples(index=False))
        ground, rungs = _ground(x), len(p.ladder)
        shape = (rungs, *ground.elev.shape)
        dist = np.frombuffer(x.dist).copy() if x.dist is not None else np.full(rungs * ground.elev.size, np.inf)
        dist = dist.reshape(shape)
        old = dist.copy()
        r, c = come.r.to_numpy(int) - key[1] * side + RIM, come.c.to_numpy(int) - key[2] * side + RIM
        near = (r < shape[1] - 1) & (c < shape[2] - 1)
        np.minimum.at(dist, (come.rung.to_numpy(int)[near], r[near], c[near]), come.label.to_numpy(float)[near])
        settle_ladder(dist.reshape(rungs, -1), ground, p)
        rows = [(*key, dist.tobytes(), None, None, None, None)]
        fell = (dist < old) & _own(ground.elev.shape)
        for i, j in MOVES:
            edge = np.zeros(ground.elev.shape, bool)
            pick = [slice(None) if not d else slice(RIM, RIM + 1) if d < 0 else slice(RIM + side - 1, RIM + side) for d in (i, j)]
            edge[pick[0], pick[1]] = True
            for k, a, b in zip(*np.nonzero(fell & edge)):
                rows.append((key[0], key[1] + i, key[2] + j, None, k, a - RIM + key[1] * side, b - RIM + key[2] * side, dist[k, a, b]))
        return pd.DataFrame(rows, columns=["solve_id", "tr", "tc", "dist", "rung", "r", "c", "label"])

    held = packed.join(news.select(*TILE).distinct(), TILE, "left_semi")
    held = held.withColumn("dist", F.lit(None).cast("binary")) if state is None else held.join(state.select(*TILE, "dist"), TILE, "left")
    return held.groupBy(*TILE).cogroup(news.groupBy(*TILE)).applyInPandas(run, LABELS)


def _latest(rounds: list[DataFrame]) -> DataFrame:
    """Of each tile the labels of its last round."""
    every = rounds[0].withColumn("round", F.lit(0))
    for n, x in enumerate(rounds[1:], 1):
        every = every.unionByName(x.withColumn("round", F.lit(n)))
    return every.join(every.groupBy(*TILE).agg(F.max("round").alias("round")), [*TILE, "round"])


def labels(grid: DataFrame, solves: DataFrame, targets: DataFrame, p: GlideParams = GlideParams(), side: int = 256) -> tuple[DataFrame, DataFrame]:
    """The packed tiles, and ``(solve_id, tr, tc, dist)``: for each tile that is reached the least path
    lengths at every ratio of the ladder, rung by rung, as doubles with the tile's rim."""
    ensure_checkpoints(grid.sparkSession)
    packed = tiles(grid, solves, targets, p, side).checkpoint()
    start = F.explode(F.sequence(F.lit(0), F.lit(len(p.ladder) - 1)))
    news = solves.select(
        "solve_id", F.floor(F.col("r0") / side).alias("tr"), F.floor(F.col("c0") / side).alias("tc"),
        start.alias("rung"), F.col("r0").alias("r"), F.col("c0").alias("c"), F.lit(0.0).alias("label"),
    )
    rounds: list[DataFrame] = []
    while True:
        out = _round(packed, _latest(rounds) if rounds else None, news, p, side).checkpoint()
        rounds.append(out.where("dist is not null").select(*TILE, "dist"))
        news = out.where("dist is null").drop("dist")
        # labels for a tile that has no cells lead nowhere
        news = news.join(packed.select(*TILE), TILE, "left_semi")
        if news.isEmpty():
            return packed, _latest(rounds).drop("round")


SEGMENTS = "solve_id long, target_id long, rung int, hop int, length_m double, nodes array<struct<r:long,c:long>>, r long, c long"


def _segments(held: DataFrame, wanted: DataFrame, p: GlideParams, side: int) -> DataFrame:
    """Walk back from ``wanted(solve_id, tr, tc, target_id, r, c, rung, hop)`` through one tile each:
    the cells passed, and where the path comes from the tile beside it, that cell as ``r`` and ``c``."""

    def run(key: tuple[pa.Scalar, ...], tile: pa.Table, asked: pa.Table) -> pa.Table:
        parts = []
        if len(tile) and len(asked):
            x = next(tile.to_pandas().itertuples(index=False))
            ground, rungs = _ground(x), len(p.ladder)
            dist, width = np.frombuffer(x.dist).reshape(rungs, -1), ground.elev.shape[1]
            own = _own(ground.elev.shape).ravel()
            corner = [k.as_py() * side - RIM for k in key[1:]]
            r, c, hop = (asked.column(n).to_numpy() for n in ("r", "c", "hop"))
            at = (r - corner[0]) * width + c - corner[1]
            # the lowest rung that reaches; a later hop has its rung already
            reach = np.isfinite(dist[:, at])
            rung = np.where(hop > 0, pc.fill_null(asked.column("rung"), 0).to_numpy(), np.where(reach.any(axis=0), reach.argmax(axis=0), -1))
            for k in np.unique(rung[rung >= 0]):
                mine = np.flatnonzero(rung == k)
                prev, walk = entered_from(dist[k], ground), [at[mine]]
                while (on := (walk[-1] >= 0) & own[np.maximum(walk[-1], 0)]).any():
                    walk.append(np.where(on, prev[np.maximum(walk[-1], 0)], -1))
                steps = np.stack(walk, axis=1)
                seen = steps >= 0
                inside = seen & own[np.maximum(steps, 0)]
                last = np.arange(len(mine)), seen.sum(axis=1) - 1
                place = lambda s: [pa.array(i + o, pa.int64()) for i, o in zip(np.divmod(s, width), corner)]
                nodes = pa.StructArray.from_arrays(place(steps[inside]), names=["r", "c"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inside.sum(axis=1))]), pa.int32()), nodes)
                leaves = [pc.if_else(pa.array(inside[last]), None, v) for v in place(steps[last])]
                ids = [pa.repeat(key[0], len(mine)), asked.column("target_id").take(pa.array(mine)).combine_chunks(), pa.array(np.full(len(mine), k)), pa.array(hop[mine]), pa.array(dist[k, at[mine]])]
                parts.append(pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip([*ids, lists, *leaves], out)], schema=out))
        return pa.Table.from_batches(parts, schema=out)

    schema = StructType.fromDDL(SEGMENTS)
    out = to_arrow_schema(schema)
    return held.groupBy(*TILE).cogroup(wanted.groupBy(*TILE)).applyInArrow(run, schema)


def reachability(grid: DataFrame, solves: DataFrame, targets: DataFrame, p: GlideParams = GlideParams(), side: int = 256) -> DataFrame:
    """``(solve_id, target_id, rung, length_m, nodes)`` of targets that some rung of the ladder reaches.

    The lowest such rung decides the path; of equal ways into a cell it takes the one from the
    lowest cell. A task settles one tile of ``side`` cells; rounds are as many as the tiles that a
    path crosses, and are checkpointed. A target outside its window or a solve without targets has
    no row; the cell glided from is exempt.
    """
    packed, settled = labels(grid, solves, targets, p, side)
    held = packed.join(settled, TILE)
    tile = {"tr": F.floor(F.col("r") / side), "tc": F.floor(F.col("c") / side)}
    none = F.lit(None).cast("int")
    wanted = targets.where("target_id is not null").select("solve_id", "target_id", "r", "c", none.alias("rung"), F.lit(0).alias("hop")).withColumns(tile)
    # a target beyond its tile's known cells is not reached
    shape = held.select(*TILE, (F.col("rows") - 2 * RIM).alias("h"), (F.length("elev") / 8 / F.col("rows") - 2 * RIM).alias("w"))
    wanted = wanted.join(shape, TILE).where(f"r - tr * {side} < h and c - tc * {side} < w").drop("h", "w")
    found = []
    while True:
        part = _segments(held, wanted, p, side).checkpoint()
        found.append(part)
        wanted = part.where("r is not null").select("solve_id", "target_id", "r", "c", "rung", (F.col("hop") + 1).alias("hop")).withColumns(tile)
        if wanted.isEmpty():
            break
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    ladder = F.array(*[F.lit(x) for x in p.ladder])
    if len(found) == 1:
        return every.select("solve_id", "target_id", F.element_at(ladder, F.col("rung") + 1).alias("rung"), "length_m", F.reverse("nodes").alias("nodes"))
    whole = every.groupBy("solve_id", "target_id").agg(
        F.first("rung").alias("rung"), F.max("length_m").alias("length_m"), F.array_sort(F.collect_list(F.struct("hop", "nodes"))).alias("parts")
    )
    nodes = F.reverse(F.flatten(F.transform("parts", lambda x: x.nodes)))
    return whole.select("solve_id", "target_id", F.element_at(ladder, F.col("rung") + 1).alias("rung"), "length_m", nodes.alias("nodes"))
