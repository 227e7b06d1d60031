"""Routes over an elevation grid: windows, scores, choice and profiles; reachability is in `reach`.

Tables: ``solves(solve_id, r0, c0, alt_m, north_m, east_m)``, one position to glide from, with the
ground size of a cell; ``grid(solve_id, r, c, elev)``, its window of cells, those of unknown height
absent or NODATA; ``targets(solve_id, target_id, r, c, elev_m)``; ``paths(solve_id, target_id,
nodes)`` with nodes as ``array<struct<r, c>>``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from glidemesh.operators import walks
from glidemesh.operators.raster import NODATA
from glidemesh.operators.reach import GlideParams, headroom, reachability  # noqa: F401
from glidemesh.operators.resolve import ensure_checkpoints

METRES_PER_DEGREE = 111_320.0
PATH = ["solve_id", "target_id"]


def routing_windows(solves: DataFrame, per_degree: int = 1_200, pooled: int = 3) -> DataFrame:
    """``solves(solve_id, lat, lon, radius_m)`` with the lattice window of each.

    A lattice row is 1 / ``per_degree`` degrees, counted from the pole; columns count from 180 west.
    A cell of the window pools ``pooled`` rows and as many columns as make it about square, and
    windows begin and end at multiples of those, so a block is the same whoever asks.
    """
    shrink = F.greatest(F.lit(0.2), F.cos(F.radians("lat")))
    pad = F.col("radius_m") / METRES_PER_DEGREE
    across = F.greatest(F.lit(1), F.floor(pooled / shrink + 0.5)).cast("long")
    row = lambda lat: F.floor((90 - lat) * per_degree)
    col = lambda lon: F.floor((lon + 180) * per_degree)
    w = solves.withColumns({"shrink": shrink, "k": across, "pad": pad})
    w = w.withColumns(
        {
            "row0": F.floor(row(F.col("lat") + F.col("pad")) / pooled) * pooled,
            "row1": F.ceil((row(F.col("lat") - F.col("pad")) + 1) / pooled) * pooled,
            "col0": F.floor(col(F.col("lon") - F.col("pad") / F.col("shrink")) / F.col("k")) * F.col("k"),
            "col1": F.ceil((col(F.col("lon") + F.col("pad") / F.col("shrink")) + 1) / F.col("k")) * F.col("k"),
        }
    )
    step = F.col("k") / per_degree
    return w.select(
        "solve_id", "lat", "lon", "k", "row0", "row1", "col0", "col1",
        ((F.col("row1") - F.col("row0")) / pooled).cast("long").alias("rows"),
        ((F.col("col1") - F.col("col0")) / F.col("k")).cast("long").alias("cols"),
        (90 - F.col("row0") / per_degree).alias("north"), (F.col("col0") / per_degree - 180).alias("west"),
        F.lit(pooled / per_degree).alias("lat_step"), step.alias("lon_step"),
        F.lit(pooled / per_degree * METRES_PER_DEGREE).alias("north_m"), (step * METRES_PER_DEGREE * F.col("shrink")).alias("east_m"),
    )


def routing_grid(cells: DataFrame, windows: DataFrame, per_degree: int = 1_200, pooled: int = 3) -> DataFrame:
    """``(solve_id, r, c, elev)``: the highest known of the lattice cells ``(gr, gc, elev)`` of each block.

    Windows meet cells by the whole degrees they touch; a block without a known cell has no row.
    """
    span = lambda a, b: F.sequence(F.floor(F.col(a) / per_degree), F.floor((F.col(b) - 1) / per_degree))
    w = windows.select("solve_id", "k", "row0", "row1", "col0", "col1", F.explode(span("row0", "row1")).alias("dr"))
    w = w.withColumn("dc", F.explode(span("col0", "col1")))
    known = cells.where(F.col("elev") != NODATA).select(
        F.floor(F.col("gr") / per_degree).alias("dr"), F.floor(F.col("gc") / per_degree).alias("dc"), "gr", "gc", "elev"
    )
    met = w.join(known, ["dr", "dc"]).where("gr >= row0 and gr < row1 and gc >= col0 and gc < col1")
    at = [F.floor((F.col("gr") - F.col("row0")) / pooled).alias("r"), F.floor((F.col("gc") - F.col("col0")) / F.col("k")).alias("c")]
    return met.groupBy("solve_id", *at).agg(F.max("elev").alias("elev"))


def coverage(grid: DataFrame, windows: DataFrame) -> DataFrame:
    """``(solve_id, covered, coverage)``: known blocks of a window, and their share of it."""
    n = grid.groupBy("solve_id").agg(F.count("*").alias("covered"))
    covered = F.coalesce("covered", F.lit(0))
    return windows.join(n, "solve_id", "left").select("solve_id", covered.alias("covered"), (covered / (F.col("rows") * F.col("cols"))).alias("coverage"))


def _arrays(grid: pa.Table, targets: pa.Table, solve: dict, p: GlideParams) -> tuple[np.ndarray, np.ndarray]:
    """Heights and floors of one window as dense arrays, NaN where there are none."""
    height = walks.numbers(grid.column("elev"))
    at = [[walks.numbers(t.column(c)).astype(int) for c in ("r", "c")] for t in (grid, targets)]
    is_known = height != NODATA
    cells = [x[is_known] for x in at[0]]
    shape = tuple(int(max([solve[a], *(x[i].max() for x in (cells, at[1]) if len(x[i]))])) + 1 for i, a in enumerate(("r0", "c0")))
    elev, floor = np.full(shape, np.nan), np.full(shape, np.nan)
    elev[cells[0], cells[1]] = height[is_known]
    np.fmin.at(floor, tuple(at[1]), walks.numbers(targets.column("elev_m")) + p.margin_m)
    return elev, floor


def score_paths(paths: DataFrame, grid: DataFrame, solves: DataFrame, targets: DataFrame, p: GlideParams = GlideParams()) -> DataFrame:
    """``paths`` (their ids and nodes) with ``ratio``, ``length_m`` and ``critical(r, c, at_m, elev)`` as a real glide.

    The ratio needed is the largest of way flown over height left at any step, arrival included. It
    is null where a step has no height left or no known ground. Where the arrival alone decides,
    there is no critical cell; of equal steps the first is critical.
    """
    known = grid.select("solve_id", "r", "c", "elev", F.lit(None).cast("double").alias("floor"))
    none = F.lit(None).cast(grid.schema["elev"].dataType)
    floors = targets.select("solve_id", "r", "c", none.alias("elev"), (F.col("elev_m") + p.margin_m).alias("floor"))
    asked = paths.select(*PATH, "nodes").join(solves.select("solve_id", "alt_m", "north_m", "east_m"), "solve_id").join(targets.select(*PATH, F.col("elev_m").alias("to_elev")), PATH)
    schema = StructType(
        [asked.schema[c] for c in (*PATH, "nodes")]
        + [StructField("length_m", DoubleType()), StructField("ratio", DoubleType())]
        + [StructField("critical", StructType([StructField("r", LongType()), StructField("c", LongType()), StructField("at_m", DoubleType()), StructField("elev", grid.schema["elev"].dataType)]))]
    )
    return walks.over_windows(known.unionByName(floors), asked, schema, lambda window, part: walks.score(window, part, p))


def pull_strings(scored: DataFrame, grid: DataFrame, solves: DataFrame, targets: DataFrame, p: GlideParams = GlideParams()) -> DataFrame:
    """``paths`` whose runs of nodes are replaced by straight legs that stay within the path's own ratio.

    From each node the farthest one is taken to which all straight legs up to it keep the ratio. A group
    is one solve's window and its paths, which are walked side by side.
    """

    out = to_arrow_schema(StructType([scored.schema[c] for c in PATH] + [scored.schema["nodes"]]))

    def run(window: pa.Table, rest: pa.Table) -> pa.Table:
        parts = []
        if len(rest) and len(window):
            solve = {c: float(rest.column(c)[0].as_py()) for c in ("r0", "c0", "alt_m", "north_m", "east_m")}
            elev, floor = _arrays(window, rest, solve, p)
            mine = rest.select([*PATH, "nodes", "ratio"]).filter(rest.column("nodes").is_valid())
            parts = [pa.RecordBatch.from_arrays(_pulled(elev, floor, solve, part, p, out), schema=out) for part in mine.to_batches(max_chunksize=walks.CHUNK) if len(part)]
        return pa.Table.from_batches(parts, schema=out)

    asked = solves.join(targets, "solve_id").join(scored.where("ratio is not null").select(*PATH, "nodes", "ratio"), PATH, "left")
    asked = asked.select(*PATH, "r0", "c0", "alt_m", "north_m", "east_m", "r", "c", "elev_m", "nodes", "ratio")
    return grid.groupBy("solve_id").cogroup(asked.groupBy("solve_id")).applyInArrow(run, StructType([scored.schema[c] for c in PATH] + [scored.schema["nodes"]]))


def _pulled(elev, floor, solve: dict, part: pa.RecordBatch, p: GlideParams, out: pa.Schema) -> list[pa.Array]:
    """The ids and the nodes that are left of some paths, all walked at once, a leg of each at a time.

    Legs that begin with the same way flown at one node and end at one node are walked once.
    """
    lists = part.column("nodes")
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = lists.flatten()
    y, x = (walks.numbers(flat.field(i)).astype(int) for i in ("r", "c"))
    first = np.cumsum(size) - size
    limit = walks.numbers(part.column("ratio"))
    kept = np.zeros(len(y), bool)
    kept[first[size > 0]] = True
    at, to, flown = first.copy(), first + 1, np.zeros(len(size))
    end = first + size - 1
    going = np.flatnonzero(to <= end)
    width = int(elev.shape[1])
    while len(going):
        a, b, way = at[going], to[going], flown[going]
        # the first leg from a node is taken in any case
        free = b == a + 1
        good = free.copy()
        if not free.all():
            asked = np.flatnonzero(~free)
            legs = np.stack([way[asked], y[a[asked]] * width + x[a[asked]], y[b[asked]] * width + x[b[asked]]], axis=1)
            _, one, same = np.unique(legs, axis=0, return_index=True, return_inverse=True)
            i, j = a[asked[one]], b[asked[one]]
            whole, before = _needed(elev, floor, solve, y[i], x[i], y[j], x[j], way[asked[one]], p)
            need = np.where(b[asked] == end[going[asked]], before[same.ravel()], whole[same.ravel()])
            good[asked] = need <= limit[going[asked]]
        on = good & (b < end[going])
        to[going[on]] += 1
        # a path stops at the last node that it could reach, or at its end
        stop = np.where(good, b, b - 1)[~on]
        who = going[~on]
        leg = np.hypot((y[stop] - y[at[who]]) * solve["north_m"], (x[stop] - x[at[who]]) * solve["east_m"])
        flown[who] += leg
        kept[stop] = True
        at[who], to[who] = stop, stop + 1
        going = going[to[going] <= end[going]]
    left = np.bincount(np.repeat(np.arange(len(size)), size)[kept], minlength=len(size))
    nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), flat.take(pa.array(np.flatnonzero(kept))))
    return [part.column(c).cast(out.field(c).type) for c in PATH] + [nodes.cast(out.field("nodes").type)]


def _needed(elev, floor, solve: dict, r0, c0, r1, c1, flown, p: GlideParams) -> tuple[np.ndarray, np.ndarray]:
    """The largest ratio that any step of straight legs needs, over all steps and over all but the last."""
    n = np.maximum(np.abs(r1 - r0), np.abs(c1 - c0))
    leg = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    s = np.arange(n.sum()) - begin[leg] + 1
    r = np.floor(r0[leg] + (r1 - r0)[leg] * s / n[leg] + 0.5).astype(int)
    c = np.floor(c0[leg] + (c1 - c0)[leg] * s / n[leg] + 0.5).astype(int)
    ends = flown + np.hypot((r1 - r0) * solve["north_m"], (c1 - c0) * solve["east_m"])
    way = flown[leg] + (ends - flown)[leg] * s / n[leg]
    room = headroom(solve["alt_m"], elev[r, c], floor[r, c], way, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(room > 0, way / room, np.inf)
    whole, before = np.full(len(n), -np.inf), np.full(len(n), -np.inf)
    some = n > 0
    if some.any():
        whole[some] = np.maximum.reduceat(need, begin[some])
        need[(begin + n - 1)[some]] = -np.inf
        before[some] = np.maximum.reduceat(need, begin[some])
    return whole, before


def refine_paths(paths: DataFrame, grid: DataFrame, solves: DataFrame, targets: DataFrame, p: GlideParams = GlideParams(), passes: int = 2) -> DataFrame:
    """Scored paths, string-pulled while that leaves fewer nodes and needs strictly less. Paths that
    cannot be flown as scored go."""
    ensure_checkpoints(grid.sparkSession)
    best = score_paths(paths, grid, solves, targets, p).where("ratio is not null").checkpoint()
    for _ in range(passes):
        new = score_paths(pull_strings(best, grid, solves, targets, p), grid, solves, targets, p)
        both = best.alias("o").join(new.alias("n"), PATH, "left")
        take = F.coalesce((F.col("n.ratio") < F.col("o.ratio")) & (F.size("n.nodes") < F.size("o.nodes")), F.lit(False))
        best = both.select(*PATH, *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("nodes", "length_m", "ratio", "critical")])
        best = best.checkpoint()  # each pass reads the last one twice
    return best


def direct_lines(solves: DataFrame, targets: DataFrame) -> DataFrame:
    """The straight lines as paths of two nodes."""
    node = lambda r, c: F.struct(F.col(r).cast("long").alias("r"), F.col(c).cast("long").alias("c"))
    return solves.join(targets, "solve_id").select(*PATH, F.array(node("r0", "c0"), node("r", "c")).alias("nodes"))


def choose_routes(routed: DataFrame, lines: DataFrame) -> DataFrame:
    """The better of routed and straight for each target, the straight one on a tie, with its figures beside.

    Both inputs are scored; a target with neither has no row.
    """
    j = routed.where("ratio is not null").alias("t").join(lines.where("ratio is not null").alias("l"), PATH, "full")
    direct = F.coalesce(F.col("l.ratio") <= F.col("t.ratio"), F.col("t.ratio").isNull())
    pick = [F.when(direct, F.col(f"l.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in ("ratio", "length_m", "critical", "nodes")]
    return j.select(*PATH, direct.alias("direct"), *pick, F.col("l.ratio").alias("direct_ratio"), F.col("l.length_m").alias("direct_m"))


def describe_routes(routes: DataFrame, windows: DataFrame) -> DataFrame:
    """Legs, and where on the ground the critical cell lies: its centre, height and way along."""
    w = windows.select("solve_id", "north", "west", "lat_step", "lon_step")
    return routes.join(w, "solve_id").select(
        *PATH, "direct", "ratio", "length_m", "direct_ratio", "direct_m",
        (F.size("nodes") - 1).cast("long").alias("legs"),
        (F.col("north") - (F.col("critical.r") + 0.5) * F.col("lat_step")).alias("critical_lat"),
        (F.col("west") + (F.col("critical.c") + 0.5) * F.col("lon_step")).alias("critical_lon"),
        F.col("critical.elev").alias("critical_elev"), F.col("critical.at_m").alias("critical_at_m"),
    )


def profiles(paths: DataFrame, grid: DataFrame, solves: DataFrame, n: int = 96) -> DataFrame:
    """``(solve_id, target_id, step_m, length_m, terrain)``: ``n`` heights along each path.

    A bin holds the highest known sample from the last one before it to its end; null where all are
    unknown. A path of one cell has no profile.
    """
    asked = paths.where("size(nodes) > 0").select(*PATH, "nodes").join(solves.select("solve_id", "north_m", "east_m"), "solve_id")
    schema = StructType(
        [asked.schema[c] for c in PATH]
        + [StructField("step_m", DoubleType()), StructField("length_m", DoubleType()), StructField("terrain", ArrayType(grid.schema["elev"].dataType))]
    )
    return walks.over_windows(grid.select("solve_id", "r", "c", "elev"), asked, schema, lambda window, part: walks.profile(window, part, n))
