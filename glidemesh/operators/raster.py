"""Elevation rasters as cell tables, and glide along straight lines over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

NODATA = -32768
#: Lines over one tile that go to one group.
LINES = 20_000


def _by_tile(df: DataFrame) -> DataFrame:
    """Whole tiles to a task, in a set number of tasks: cells pack so well that by bytes a few tasks would get them all.

    Twice the session's number: with the same, a shuffle by tile further up would stand for this one.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile")


def pool_max(cells: DataFrame, fr: int, fc: int) -> DataFrame:
    """Highest cell of every block; missing cells never win, a block without others stays missing."""
    e = F.when(F.col("elev") != NODATA, F.col("elev"))
    return cells.groupBy("tile", F.floor(F.col("r") / fr).cast("long").alias("r"), F.floor(F.col("c") / fc).cast("long").alias("c")).agg(
        F.coalesce(F.max(e), F.lit(NODATA)).cast("long").alias("elev")
    )


def raster_gradient(cells: DataFrame) -> DataFrame:
    """v - left - up + upleft, modulo 2^16."""
    across = Window.partitionBy("tile", "r").orderBy("c")
    down = Window.partitionBy("tile", "c").orderBy("r")
    one = _by_tile(cells).withColumn("g", F.col("elev") - F.coalesce(F.lag("elev").over(across), F.lit(0)))
    two = one.withColumn("g", F.pmod(F.col("g") - F.coalesce(F.lag("g").over(down), F.lit(0)), F.lit(65536)))
    return two.select("tile", "r", "c", F.col("g").cast("long").alias("g"))


def raster_integrate(grad: DataFrame) -> DataFrame:
    """The inverse: running sums down, then across, back to signed 16 bits."""
    down = Window.partitionBy("tile", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("tile", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)
    s = _by_tile(grad).withColumn("s", F.sum("g").over(down)).withColumn("e", F.sum("s").over(across))
    u = F.pmod(F.col("e"), F.lit(65536))
    return s.select("tile", "r", "c", F.when(u >= 32768, u - 65536).otherwise(u).cast("long").alias("elev"))


def tile_index(cells: DataFrame) -> DataFrame:
    e = F.when(F.col("elev") != NODATA, F.col("elev"))
    return cells.groupBy("tile").agg(F.count("*").alias("cells"), F.count(e).alias("known"), F.max(e).cast("long").alias("highest"))


def walk_lines(pairs: DataFrame) -> DataFrame:
    """Steps ``s = 1 .. n`` of the lines ``(pair, tile, r0, c0, r1, c1)``, on the nearest cells."""
    n = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))
    each = pairs.withColumn("n", n).where("n > 0").withColumn("s", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    on = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("s") / F.col("n") + 0.5).cast("long")
    return each.withColumns({"r": on("r0", "r1"), "c": on("c0", "c1")})


def direct_score(pairs: DataFrame, cells: DataFrame, cell_m: float | tuple[float, float] = 278.0, clearance: float = 200.0, margin: float = 250.0, ramp: float = 2000.0) -> DataFrame:
    """Required ratio of the straight line of each pair ``(..., alt)``; null where terrain blocks it.

    At every step the ratio is the way flown over the height left above terrain and a clearance that
    grows over the first ``ramp`` metres; the last step is the arrival above the target's own cell.
    Ground without a cell, or with a missing one, is unknown: a line over it has no ratio. A cell is
    ``cell_m`` metres, or (north, east) metres where it is not square. Cells and lines are dealt by tile, a
    tile's lines in parts of some ``LINES``, and steps are looked up there, so steps are not shuffled.
    """
    from glidemesh.operators import walks  # it stands on this module's NODATA

    north, east = cell_m if isinstance(cell_m, tuple) else (cell_m, cell_m)
    size = pairs.groupBy("tile").agg(F.ceil(F.count("*") / LINES).alias("parts"))
    ground = cells.select("tile", "r", "c", "elev").join(size, "tile").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    lines = pairs.select("pair", "tile", "r0", "c0", "r1", "c1", "alt").join(size, "tile").withColumn("part", F.pmod(F.xxhash64("pair"), F.col("parts"))).drop("parts")
    schema = StructType([pairs.schema["pair"], StructField("ratio", DoubleType()), StructField("critical", LongType())])
    work = lambda window, part: walks.line_scores(window, part, north, east, clearance, margin, ramp)
    return walks.over_windows(ground, lines, schema, work, ("tile", "part")).withColumn("ratio", F.round("ratio", 3))
