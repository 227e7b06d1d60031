"""Cells along polylines over one window: lookups in the task that holds the window, so steps are never shuffled."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glidemesh.operators.raster import NODATA
from glidemesh.operators.reach import GlideParams, headroom

#: Paths whose steps a task holds at once.
CHUNK = 1_024


def numbers(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return col.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.cast(pa.float64()).to_numpy()


class Cells:
    """Values of cells by row and column; NaN where there is none. Of several the last, or the lowest."""

    def __init__(self, r: np.ndarray, c: np.ndarray, value: np.ndarray, lowest: bool = False):
        key = self._key(r, c)
        order = np.lexsort((-value if lowest else np.arange(len(key)), key))
        last = np.append(key[order][1:] != key[order][:-1], True) if len(key) else np.zeros(0, bool)
        self.key, self.value = key[order][last], np.append(value[order][last], np.nan)

    @staticmethod
    def _key(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return r.astype(np.int64) * (1 << 31) + c.astype(np.int64)

    def at(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        want = self._key(r, c)
        i = np.searchsorted(self.key, want)
        found = i < len(self.key)
        found[found] = self.key[i[found]] == want[found]
        return self.value[np.where(found, i, len(self.key))]


@dataclass(frozen=True)
class Walk:
    """The steps of several paths, one after the other: path, cell, way flown; and each path's length, NaN without a node."""

    path: np.ndarray
    r: np.ndarray
    c: np.ndarray
    flown: np.ndarray
    arrives: np.ndarray
    length: np.ndarray


def walk(nodes: pa.ListArray, north: np.ndarray, east: np.ndarray) -> Walk:
    size = np.nan_to_num(nodes.value_lengths().cast(pa.float64()).to_numpy(zero_copy_only=False)).astype(int)
    flat = nodes.flatten()
    y, x = (numbers(flat.field(i)) for i in (0, 1))
    first = np.cumsum(size) - size
    legs = np.maximum(size - 1, 0)
    path = np.repeat(np.arange(len(size)), legs)
    number = np.arange(len(path)) - np.repeat(np.cumsum(legs) - legs, legs)
    a = first[path] + number
    dy, dx = y[a + 1] - y[a], x[a + 1] - x[a]
    length = np.sqrt((dy * north[path]) ** 2 + (dx * east[path]) ** 2)
    before, total = np.zeros(len(path)), np.where(size > 0, 0.0, np.nan)
    for k in range(legs.max(initial=0)):  # leg by leg, as a running sum adds them
        at = (np.cumsum(legs) - legs)[legs > k] + k
        before[at] = total[path[at]]
        total[path[at]] += length[at]
    n = np.maximum(np.abs(dy), np.abs(dx)).astype(int)
    leg = np.repeat(np.arange(len(path)), n)
    s = np.arange(len(leg)) - np.repeat(np.cumsum(n) - n, n) + 1
    r = np.floor(y[a][leg] + dy[leg] * s / n[leg] + 0.5)
    c = np.floor(x[a][leg] + dx[leg] * s / n[leg] + 0.5)
    arrives = (number[leg] == legs[path[leg]] - 1) & (s == n[leg])
    return Walk(path[leg], r, c, before[leg] + length[leg] * s / n[leg], arrives, total)


def over_windows(ground: DataFrame, paths: DataFrame, schema: StructType, work, by: tuple[str, ...] = ("solve_id",)) -> DataFrame:
    """``work(cells, paths) -> columns`` for the paths of each window, some at a time; ``cells`` is the window's ground.

    A group is one position's window and its paths. Both are dealt by position, so what is shuffled
    is cells and paths, however many steps the paths have.
    """
    out = to_arrow_schema(schema)

    def run(window: pa.Table, asked: pa.Table) -> pa.Table:
        parts = [work(window, part) for part in asked.to_batches(max_chunksize=CHUNK)] if len(asked) else []
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(p, out)], schema=out) for p in parts], schema=out)

    return ground.groupBy(*by).cogroup(paths.groupBy(*by)).applyInArrow(run, schema)


def known_cells(window: pa.Table) -> Cells:
    elev = numbers(window.column("elev"))
    is_known = ~np.isnan(elev) & (elev != NODATA)
    return Cells(numbers(window.column("r"))[is_known], numbers(window.column("c"))[is_known], elev[is_known])


def floor_cells(window: pa.Table) -> Cells:
    floor = numbers(window.column("floor"))
    is_known = ~np.isnan(floor)
    return Cells(numbers(window.column("r"))[is_known], numbers(window.column("c"))[is_known], floor[is_known], lowest=True)


def score(window: pa.Table, paths: pa.RecordBatch, p: GlideParams) -> list[pa.Array]:
    """Of ``paths(solve_id, target_id, nodes, alt_m, north_m, east_m, to_elev)``: ids, nodes, length, ratio, critical cell."""
    elevs, floors = known_cells(window), floor_cells(window)
    alt, north, east, to_elev = (numbers(paths.column(c)) for c in ("alt_m", "north_m", "east_m", "to_elev"))
    w = walk(paths.column("nodes"), north, east)
    on = ~w.arrives
    path, r, c, flown = w.path[on], w.r[on], w.c[on], w.flown[on]
    elev = elevs.at(r, c)
    with np.errstate(divide="ignore", invalid="ignore"):
        room = headroom(alt[path], elev, floors.at(r, c), flown, p)
        need = np.where(room > 0, flown / room, np.inf)
        arrival = alt - to_elev - p.margin_m
        last = np.where(arrival > 0, w.length / arrival, np.nan)
    new = np.flatnonzero(np.append(True, path[1:] != path[:-1])) if len(path) else np.zeros(0, int)
    worst = np.full(len(alt), -np.inf)
    critical = np.zeros(len(alt), int)
    if len(path):
        worst[path[new]] = np.maximum.reduceat(need, new)
        top = np.flatnonzero(need == worst[path])
        critical[path[top[::-1]]] = top[::-1]  # of equal steps the first stays
    last[np.isinf(worst) & (worst > 0)] = np.nan
    flies = ~np.isnan(last)
    ratio = np.maximum(last, np.maximum(worst, 0.0))
    ground = flies & (last <= worst)
    at = critical[ground]
    put = lambda x: _spread(x[at], ground)
    cell = pa.StructArray.from_arrays(
        [put(r).cast(pa.int64()), put(c).cast(pa.int64()), put(flown), put(elev).cast(window.schema.field("elev").type)], names=["r", "c", "at_m", "elev"], mask=pa.array(~ground)
    )
    return [paths.column("solve_id"), paths.column("target_id"), paths.column("nodes"), _plain(w.length), _plain(np.where(flies, ratio, np.nan)), cell]


def line_scores(window: pa.Table, lines: pa.RecordBatch, north: float, east: float, clearance: float, margin: float, ramp: float) -> list[pa.Array]:
    """Of ``lines(pair, r0, c0, r1, c1, alt)`` that have a step: pair, ratio (null where blocked), the first step that decides."""
    r0, c0, r1, c1, alt = (numbers(lines.column(c)) for c in ("r0", "c0", "r1", "c1", "alt"))
    dy, dx = r1 - r0, c1 - c0
    n = np.maximum(np.abs(dy), np.abs(dx)).astype(int)
    length = np.sqrt(dy**2 + dx**2) * north if north == east else np.sqrt(dy**2 * north**2 + dx**2 * east**2)
    line = np.repeat(np.arange(len(n)), n)
    first = (np.cumsum(n) - n)[n > 0]
    s = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + 1
    elev = known_cells(window).at(np.floor(r0[line] + dy[line] * s / n[line] + 0.5), np.floor(c0[line] + dx[line] * s / n[line] + 0.5))
    flown = length[line] * s / n[line]
    above = alt[line] - elev
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(s == n[line], above - margin, above - clearance * np.minimum(1.0, flown / ramp))
        need = np.where(room > 0, flown / room, np.inf)
    some = np.flatnonzero(n)
    worst = np.maximum.reduceat(need, first) if len(some) else np.zeros(0)
    top = np.flatnonzero(need == np.repeat(worst, n[some]))
    critical = np.zeros(len(n), int)
    critical[line[top[::-1]]] = s[top[::-1]]
    return [lines.column("pair").take(pa.array(some)), pa.array(worst, mask=np.isinf(worst)), pa.array(critical[some])]


def profile(window: pa.Table, paths: pa.RecordBatch, n: int) -> list[pa.Array]:
    """Of ``paths(solve_id, target_id, nodes, north_m, east_m)`` with a step: ids, step, length, the highest cell of each bin."""
    elevs = known_cells(window)
    w = walk(paths.column("nodes"), *(numbers(paths.column(c)) for c in ("north_m", "east_m")))
    steps = np.bincount(w.path, minlength=len(paths))
    some = np.flatnonzero(steps)
    # each path's first node goes before its steps
    size = steps[some] + 1
    start = np.cumsum(size) - size
    total = int(size.sum())
    is_step = np.ones(total, bool)
    is_step[start] = False
    nodes = paths.column("nodes").take(pa.array(some))
    head = nodes.flatten().take(pa.array((np.cumsum(lengths := nodes.value_lengths().to_numpy(zero_copy_only=False)) - lengths).astype(np.int64)))
    r, c, flown = np.empty(total), np.empty(total), np.zeros(total)
    r[start], c[start] = numbers(head.field(0)), numbers(head.field(1))
    r[is_step], c[is_step], flown[is_step] = w.r, w.c, w.flown
    high = np.nan_to_num(np.append(elevs.at(r, c), np.nan), nan=-np.inf)
    length = flown[start + size - 1] if total else np.zeros(0)
    step, group = length / (n - 1), np.repeat(np.arange(len(some)), size)
    terrain = np.full((len(some), n), -np.inf)
    for i in range(n if total else 0):
        want = i * step
        low = start + np.maximum(np.add.reduceat((flown < want[group]).astype(int), start), 1) - 1
        end = np.maximum(start + np.add.reduceat((flown <= (want + step)[group]).astype(int), start), low + 1)
        terrain[:, i] = np.maximum.reduceat(high, np.stack([low, end], axis=1).ravel())[::2]
    flat = pa.array(terrain.ravel(), mask=np.isinf(terrain.ravel())).cast(window.schema.field("elev").type)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * n, pa.int32()), flat)
    ids = [paths.column(c).take(pa.array(some)) for c in ("solve_id", "target_id")]
    return [*ids, pa.array(step), pa.array(length), lists]


def _plain(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x))


def _spread(x: np.ndarray, where: np.ndarray) -> pa.Array:
    out = np.full(len(where), np.nan)
    out[where] = x
    return _plain(out)
