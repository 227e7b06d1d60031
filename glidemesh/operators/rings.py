"""The sites around each point that can be among its first ``k``, by growing rings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from math import degrees, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from glidemesh.functions import geo
from glidemesh.operators.resolve import cell_of, cells_around, checkpoint_folder

#: Pairs that a task compares at once, sites of a block on average, and how far a distance may be off here.
PAIRS, BLOCK, OFF, OFF_M = 50_000, 2_000, 1e-9, 1e-6
#: Below this distance (share, metres) two distances are not told apart here; beyond this ring none is.
CLOSE, CLOSE_M, SURE_M = 1e-12, 2e-8, 5_000_000.0


#: Stretches of a list, and whether their order is still to be told; none where the whole list is in order.
PARTS = ArrayType(StructType([StructField("begin", IntegerType()), StructField("size", IntegerType()), StructField("untold", BooleanType())]))


def saved(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read back: worked out once, where a checkpoint does it twice."""
    out = f"{checkpoint_folder(df.sparkSession)}/rings-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _spots(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


def _numbers(col: pa.Array) -> np.ndarray:
    return col.cast(pa.float64()).to_numpy(zero_copy_only=False)


class _Block:
    """A block's sites in rows a third of the ring high, by longitude in a row."""

    def __init__(self, sites: pa.Array, k: int, ring: float, last: bool):
        lat, lon, elev = (_numbers(sites.field(c)) for c in ("lat", "lon", "elev_m"))
        seq = _numbers(sites.field("src_seq"))
        # of sites at one place and height only the first k can be among the first k
        order = np.lexsort((-seq if last else seq, np.nan_to_num(elev, nan=np.inf), lon, lat))
        at = np.stack([lat[order], lon[order], np.nan_to_num(elev[order], nan=np.inf)])
        new = np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(axis=0)])
        order = order[np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]
        self.reach = degrees(ring / geo.EARTH_M) * (1 + 1e-9) + 1e-9
        self.step, self.low, self.mid = self.reach / 3, lat.min(), lon[0]
        row, x = np.floor((lat[order] - self.low) / self.step), self._east(lon[order])
        near = np.lexsort((x, row))
        self.order, self.key = order[near], row[near] * 1000 + x[near]
        self.elev, self.spots = np.nan_to_num(elev[self.order], nan=np.inf), _spots(lat[self.order], lon[self.order])
        self.seq, self.lat, self.lon = seq[self.order], lat[self.order], lon[self.order]
        # heights that are no numbers come between those with a ratio and those without: left to the columns
        self.odd = (np.isnan(elev) & sites.field("elev_m").is_valid().to_numpy(zero_copy_only=False))[self.order]

    def _east(self, lon: np.ndarray) -> np.ndarray:
        return (lon - self.mid + 540) % 360 - 180

    def around(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the candidates of each point begin and how many they are, row by row."""
        first = np.floor((lat - self.reach - self.low) / self.step)
        row = first[:, None] + np.arange(8)
        full = np.abs(lat) + self.reach >= 90
        wide = np.degrees(np.arcsin(np.minimum(1, np.sin(np.radians(self.reach)) / np.cos(np.radians(np.where(full, 0, lat)))))) + 1e-9
        x = self._east(lon)
        all_ = full | (x - wide < -180) | (x + wide > 180)
        lo, hi = np.where(all_, -200, x - wide)[:, None], np.where(all_, 200, x + wide)[:, None]
        a, b = np.searchsorted(self.key, row * 1000 + lo), np.searchsorted(self.key, row * 1000 + hi, "right")
        return a, b - a


def _ordered(point: np.ndarray, key: np.ndarray, points: int) -> np.ndarray:
    """The order by point and key; ``point`` rises already."""
    size = np.bincount(point, minlength=points)
    most = int(size.max(initial=0))
    if points * most > 8 * len(point):
        return np.lexsort((key, point))
    start = np.cumsum(size) - size
    wide = np.full((points, most), np.inf)
    held = np.arange(most) < size[:, None]
    wide[held] = key
    return (np.argsort(wide, axis=1) + start[:, None])[held]


def _first(block: _Block, lat, lon, alt, strange, k: int, ring: float, radius: float, margin: float, lowest: float, ordered: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """``(point, site, done, parts)``: the candidates that can be among the first ``k`` of each point, and
    whether no site beyond the ring can be. Distances are rough here, so what is close to the k-th stays.

    ``ordered`` leaves the first ``k`` in order by ratio, distance and ``src_seq``. Where some are too close
    for their order or the radius to be told, they stay, and ``parts`` cuts the point's list into those told
    and untold: point, begin, size and whether untold. Nothing is told of ``strange`` points.
    """
    begin, n = block.around(lat, lon)
    total = n.sum(axis=1)
    point = np.repeat(np.arange(len(lat)), total)
    flat = n.ravel()
    ends = np.cumsum(flat)
    site = np.repeat(begin.ravel() - (ends - flat), flat) + np.arange(len(point))
    at, chord = _spots(lat, lon), np.zeros(len(point))
    for i in range(3):
        gap = np.repeat(at[:, i], total) - block.spots[site, i]
        chord += gap * gap
    d = 2 * geo.EARTH_M * np.arcsin(np.minimum(1, np.sqrt(chord) / 2))
    inside = d <= ring * (1 + OFF) + OFF_M
    point, site, d, chord = point[inside], site[inside], d[inside], chord[inside]
    done, none = np.zeros(len(lat), bool), tuple(np.zeros(0, int) for _ in range(4))
    if not len(point):
        return point, site, done, none
    room = alt[point] - block.elev[site] - margin
    usable = room > 0
    per = np.where(usable, room, 1)
    # those without a ratio come last, by distance; a chord's square is the same for all sites of a place
    key = np.where(usable, d / per, 1e200 * chord + 1e150)
    order = _ordered(point, key, len(lat))
    site, d, per, usable, key = (x[order] for x in (site, d, per, usable, key))
    first = np.concatenate([[True], point[1:] != point[:-1]])
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(point)))
    best = np.arange(len(point)) - np.repeat(start, size) < k
    above, below = d * (1 + OFF) + OFF_M, d * (1 - OFF) - OFF_M
    worst = np.maximum.reduceat(np.where(best, np.where(usable, above / per, np.inf), -np.inf), start)
    far = np.maximum.reduceat(np.where(best & ~usable, above, -np.inf), start)
    sure = np.add.reduceat((best & (above <= ring)).astype(int), start) >= k
    top = alt[point[start]] - lowest - margin
    with np.errstate(divide="ignore", invalid="ignore"):
        done[point[start]] = sure & np.where(top > 0, worst < ring * (1 - OFF) / top, True)
    keep = np.where(usable, below / per <= np.repeat(worst, size), below <= np.repeat(far, size))
    if not ordered:
        return point[keep], site[keep], done, none
    # equals at one place or spot stand in a run, and so do those too close to be told apart
    a, b = site[:-1], site[1:]
    equal = ~first[1:] & (key[1:] == key[:-1])
    at = np.flatnonzero(equal)
    same = (block.lat[a[at]] == block.lat[b[at]]) & (block.lon[a[at]] == block.lon[b[at]])
    equal[at] = same & (~usable[at] | (block.elev[a[at]] == block.elev[b[at]]))
    off = (d * CLOSE + CLOSE_M) / per
    off = np.where(usable, off, (2 * np.sqrt(np.maximum(key - 1e150, 0) / 1e200) + off / geo.EARTH_M) * off / geo.EARTH_M * 1e200)
    unsure = ~first[1:] & ~equal & (usable[1:] == usable[:-1]) & (key[1:] - key[:-1] <= off[1:] + off[:-1])
    begins = np.concatenate([[True], ~(equal | unsure)])
    run, heads = np.cumsum(begins) - 1, np.flatnonzero(begins)
    untold = (np.logical_or.reduceat(np.append(unsure, False), heads) & best[heads])[run]
    odd = block.odd[site] | (np.abs(d - radius) <= d * OFF + OFF_M)
    if equal.any():  # the lowest number of equals first
        at = np.flatnonzero(np.concatenate([[False], equal]) | np.append(equal, False))
        seq = block.seq[site[at]]
        odd[at] |= ~(np.abs(seq) < 2**53)
        site[at] = site[at[np.lexsort((seq, np.cumsum(np.concatenate([[True], ~equal]))[at]))]]
    every = strange | (ring > SURE_M)
    every[point[start]] |= np.logical_or.reduceat(odd, start)
    whole = every[point]
    keep &= whole | ((best | untold) & (d <= radius))
    point, site, untold, run = point[keep], site[keep], (untold | whole)[keep], np.where(whole, -1, run)[keep]
    if not untold.any():
        return point, site, done, none
    first = np.concatenate([[True], point[1:] != point[:-1]])
    part = np.flatnonzero(first | np.concatenate([[False], (untold[1:] != untold[:-1]) | (untold[1:] & (run[1:] != run[:-1]))]))
    size = np.diff(np.append(part, len(point)))
    begin = part - np.maximum.accumulate(np.where(first, np.arange(len(point)), 0))[part]
    mixed = np.bincount(point[part], weights=untold[part], minlength=len(lat)) > 0
    some = mixed[point[part]]
    return point, site, done, (point[part][some], begin[some], size[some], untold[part][some])


def first_around(sites: DataFrame, points: DataFrame, k: int, radius_m: float, margin_m: float = 0.0, last: bool = False, ordered: bool = False) -> DataFrame:
    """``(p, near)``: each point with the sites within the radius that can be among its first ``k`` by
    ratio and distance (``k`` and those that are as good but for rounding, in no order); only a few of
    all pairs are looked at. Sites need ``src_seq, lat, lon, elev_m``, points ``lat, lon, alt_m``; without heights
    the distance alone counts. Of sites at one place and height the lowest ``src_seq`` come first, or the ``last``.

    Points and the sites around meet in blocks, by one shuffle of the rows and not of pairs. In its task
    a point's ring grows from one that holds some ``4 k`` sites where sites are as dense as on average, to twice
    the area each time, up to the radius. No site beyond a ring needs less than the ring's width over the
    height above the lowest site; a point with ``k`` sites below that is done.

    ``ordered`` leaves out what is not among the first ``k`` and gives ``(p, near, parts)``: sites in order by
    ratio, distance and ``src_seq``, but for the untold ``parts`` of a list, whose order is still to be told.
    """
    known = sites.where("lat is not null and lon is not null")
    fine = degrees(radius_m / geo.EARTH_M) / 12
    n, cells, lowest = known.agg(F.count("*"), F.countDistinct(cell_of(F.col("lat"), F.col("lon"), fine)), F.min("elev_m")).first()
    dense = n / max(cells, 1) / (radius_m / 12) ** 2
    rings = [min(radius_m, sqrt(4 * k / (pi * dense))) if n else radius_m]
    while rings[-1] < radius_m:
        rings.append(min(rings[-1] * sqrt(2), radius_m))
    lowest = float("nan") if lowest is None else float(lowest)
    # where every site within the radius is wanted, smaller blocks share the work out better
    wide = radius_m if k < n else radius_m / 2
    step = min(degrees(max(wide, sqrt(BLOCK / dense) if n else 0.0) / geo.EARTH_M), 60.0)
    # no more tasks than there are blocks, twice over
    tasks = min(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(8, int(2 * cells * (fine / max(step, fine)) ** 2) + 1))
    of = F.struct(*points.columns).alias("p")
    asked = points.where("lat is not null and lon is not null").select(of)
    none = F.lit(None).cast(asked.schema["p"].dataType).alias("p")
    s = known.select(F.struct(*sites.columns).alias("s"), none, F.explode(cells_around(F.col("lat"), F.col("lon"), radius_m, step)).alias("g"))
    o = asked.select(F.lit(None).cast(s.schema["s"].dataType).alias("s"), "p", cell_of(F.col("p.lat"), F.col("p.lon"), step).alias("g"))
    schema = StructType([asked.schema["p"], StructField("near", ArrayType(s.schema["s"].dataType)), StructField("parts", PARTS)])
    dealt = s.union(o).select(F.concat_ws(":", "g.gy", "g.gx").alias("g"), "s", "p").repartition(tasks, "g").sortWithinPartitions("g", F.col("p").isNotNull())
    site_type = to_arrow_type(s.schema["s"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, blocks = None, [], None, {}
        for batch in batches:
            names = batch.column("g").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if names[a] != now:
                    now, parts, held, blocks = names[a], [], None, {}
                piece = batch.slice(a, b - a)
                some = piece.column("s").filter(piece.column("s").is_valid())
                if len(some):
                    parts.append(some)
                p = piece.column("p").filter(piece.column("p").is_valid())
                if not len(p):
                    continue
                if held is None:
                    held, parts = pa.concat_arrays(parts) if parts else pa.array([], site_type), []
                yield from _answers(p, held, blocks)

    def _answers(p, held, blocks):
        """Points ring by ring; a block's sites are put in order for a ring when it is first asked for."""
        lat, lon, alt = (_numbers(p.field(c)) for c in ("lat", "lon", "alt_m"))
        strange = np.isnan(alt) & p.field("alt_m").is_valid().to_numpy(zero_copy_only=False)
        open_ = np.arange(len(lat))
        if not len(held):
            yield _out(p, np.zeros(len(lat), int), pa.array([], site_type), np.zeros(len(lat), int), [np.zeros(0, int)] * 3)
            return
        for ring in rings:
            if ring not in blocks:
                blocks[ring] = _Block(held, k, ring, last)
            block, end, left = blocks[ring], ring >= radius_m, []
            total = np.cumsum(block.around(lat[open_], lon[open_])[1].sum(axis=1))
            i = 0
            while i < len(open_):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
                at = open_[i:j]
                point, site, done, (owner, *parts) = _first(block, lat[at], lon[at], alt[at], strange[at], k, ring, radius_m, margin_m, lowest, ordered)
                go = np.ones(j - i, bool) if end else done
                keep, cut = go[point], go[owner]
                sizes, cuts = (np.bincount(x, minlength=j - i)[go] for x in (point[keep], owner[cut]))
                yield _out(p.take(pa.array(at[go])), sizes, held.take(pa.array(block.order[site[keep]])), cuts, [x[cut] for x in parts])
                left.append(at[~go])
                i = j
            open_ = np.concatenate(left)
            if not len(open_):
                return

    def _out(p, sizes, near, cuts, parts):
        ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        told = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int32(), pa.int32(), pa.bool_()))], names=["begin", "size", "untold"])
        return pa.RecordBatch.from_arrays([p, pa.ListArray.from_arrays(ends(sizes), near), pa.ListArray.from_arrays(ends(cuts), told)], names=["p", "near", "parts"])

    found = dealt.mapInArrow(run, schema)
    return found if ordered else found.drop("parts")
