"""Geospatial column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
C = F.col


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres on a sphere; null where a coordinate is."""
    la1, lo1, la2, lo2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to below 360."""
    la1, la2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(la2)
    x = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def heading_delta(a, b) -> Column:
    """Difference of two runway headings; a runway has two directions, so modulo 180."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def usable_height(alt, elev, margin: float) -> Column:
    return alt - elev - margin


def glide_ratio(distance, alt, elev, margin: float) -> Column:
    """Required glide ratio; null where there is no height to use."""
    h = usable_height(alt, elev, margin)
    return F.when(h > 0, distance / h)


def glide_reason(alt, elev, margin: float) -> Column:
    return F.when(elev.isNull(), "no-elevation").when(usable_height(alt, elev, margin) <= 0, "too-low").otherwise("ok")


def tile_key(lat, lon) -> Column:
    """Key of the 1 degree tile; a tile owns its upper latitude edge."""
    la, lo = (F.ceil(lat) - 1).cast("int"), F.floor(lon).cast("int")
    ns = F.when(la < 0, "S").otherwise("N")
    ew = F.when(lo < 0, "W").otherwise("E")
    return F.concat(ns, F.lpad(F.abs(la).cast("string"), 2, "0"), ew, F.lpad(F.abs(lo).cast("string"), 3, "0"))


def parse_tile_key(key) -> Column:
    """``struct(lat0, lon0)`` of a tile's key; null for what is none."""
    part = lambda i: F.regexp_extract(key, r"^([NS])(\d{2})([EW])(\d{3})$", i)
    signed = lambda i, minus: F.when(part(i) == minus, -1).otherwise(1) * part(i + 1).try_cast("int")
    return F.when(part(1) != "", F.struct(signed(1, "S").alias("lat0"), signed(3, "W").alias("lon0")))


def tiles_for_bounds(south, west, north, east) -> Column:
    """Keys of the tiles that a box touches, south to north, then west to east."""
    rows = F.sequence(F.ceil(south), F.ceil(north))
    cols = F.sequence(F.floor(west), F.floor(east))
    # any point of a tile's upper edge and right of its left edge names it
    return F.flatten(F.transform(rows, lambda a: F.transform(cols, lambda o: tile_key(a.cast("double"), o.cast("double")))))


def cell_centre(row, col, per_degree: int = 1200) -> Column:
    """``struct(lat, lon)`` of the middle of a cell of the global lattice, whose rows count from the north."""
    return F.struct((90 - (row + 0.5) / per_degree).alias("lat"), ((col + 0.5) / per_degree - 180).alias("lon"))


def profile_lines(ground, step_m, alt, ratio, clearance) -> Column:
    """Ground, the height to stay above and the glide's height at each sample of a profile; unknown ground stays null."""
    return F.transform(
        ground, lambda g, i: F.struct((i * step_m).alias("at_m"), g.alias("ground"), (g + clearance).alias("envelope"), (alt - i * step_m / ratio).alias("glide"))
    )


def compass_point(deg) -> Column:
    names = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
    at = F.pmod(F.floor(deg / 22.5 + 0.5), F.lit(16)).cast("int") + 1
    # element_at of a null place would give the last name
    return F.when(deg.isNotNull(), F.element_at(F.array(*map(F.lit, names)), at))


def arrival_height(alt, path, ratio, elev) -> Column:
    return alt - path / ratio - elev


def cell_of(lat, lon, step_lat: float, step_lon: float) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are no smaller than the search radius."""
    return F.floor(lat / step_lat).cast("long"), F.floor(lon / step_lon).cast("long")
