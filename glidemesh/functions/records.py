"""Column functions over raw records of external sources, and over notes and routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glidemesh.functions.text import clean, norm_space, parse_float, slugify

#: Fixed values that must match for equal results: names of airport and frequency types by code,
#: words that tell of gliding, keys that hold a position, months as three letters.
AIRPORT_TYPES = {
    0: "Airport (civil/military)", 1: "Glider Site", 2: "Airfield Civil", 3: "International Airport",
    4: "Heliport Military", 5: "Military Aerodrome", 6: "Ultra Light Flying Site", 7: "Heliport Civil",
    8: "Aerodrome Closed", 9: "Airport resp. Airfield IFR", 10: "Airfield Water", 11: "Landing Strip",
    12: "Agricultural Landing Strip", 13: "Altiport",
}
FREQ_TYPES = {0: "OTHER", 1: "A/A", 2: "AFIS", 3: "TWR", 4: "APP", 5: "ATIS", 6: "GND", 7: "INFO"}
GLIDER_WORDS = [
    "glider", "gliding", "soaring", "sailplane", "planeur", "vol a voile", "vol à voile",
    "segelflug", "segelfluggelände", "segelflugplatz", "aliante", "volo a vela",
]
POINT_KEYS = [
    ("geometry.coordinates[1]", "geometry.coordinates[0]"), ("latitude", "longitude"), ("lat", "lon"), ("lat", "lng"),
    ("properties.latitude", "properties.longitude"), ("properties.lat", "properties.lon"),
    ("location.latitude", "location.longitude"), ("properties.location.latitude", "properties.location.longitude"),
]
MONTHS = {
    "JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12,
    "ENE": 1, "ABR": 4, "AGO": 8, "DIC": 12, "MRZ": 3, "MAI": 5, "OKT": 10, "DEZ": 12,
}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(str(x)) for kv in d.items() for x in kv])


def first_path(j, *paths: str) -> Column:
    """The first of some paths of a JSON text that holds a value."""
    return F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{p}"), F.lit("")) for p in paths])


def extract_point(j) -> Column:
    """``struct(lat, lon)`` of a record: GeoJSON first, then known pairs of keys, then a position object."""
    num = lambda x, *p: parse_float(clean(first_path(x, *p)))
    at = first_path(j, "position", "properties.position", "location", "properties.location")
    found = [(num(j, a), num(j, b)) for a, b in POINT_KEYS] + [(num(at, "lat", "latitude"), num(at, "lon", "lng", "longitude"))]
    return F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lon"))) for a, b in found])


def normalize_metres(v) -> Column:
    """A number, or an object of value and unit, in metres to one decimal; an object's 0 tells nothing."""
    boxed = F.startswith(F.trim(v), F.lit("{"))
    raw = F.when(boxed, first_path(v, "value", "m", "meter", "meters")).otherwise(v)
    n = parse_float(clean(raw))
    unit = F.lower(clean(first_path(v, "unit", "uom", "unitCode")))
    metres = F.when(boxed & unit.isin("ft", "feet", "2"), n * 0.3048).otherwise(n)
    return F.bround(F.when(~boxed | (n != 0), metres), 1)


def _type(v, names: dict, unknown) -> Column:
    boxed = F.startswith(F.trim(v), F.lit("{"))
    text = clean(F.when(boxed, first_path(v, "name", "value", "code")).otherwise(v))
    return F.when(F.regexp_like(text, F.lit("^[0-9]+$")), F.coalesce(_map(names)[text.try_cast("int").cast("string")], unknown(text))).otherwise(text)


def type_name(v) -> Column:
    """An airport type's name; unknown codes stay as they are."""
    return _type(v, AIRPORT_TYPES, lambda t: t)


def freq_type_name(v) -> Column:
    """A frequency type's name; unknown codes are empty."""
    return _type(v, FREQ_TYPES, lambda t: F.lit(""))


def is_relevant(j, types: list[int], words: list[str] = GLIDER_WORDS) -> Column:
    """Whether a record's type is wanted or one of the words stands anywhere in it."""
    kind = first_path(j, "type", "properties.type").try_cast("int")
    low = F.lower(j)
    named = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.coalesce(kind.isin(types), F.lit(False)) | F.coalesce(named, F.lit(False))


def _at(lat, lon, digits: int) -> list[Column]:
    return [F.translate(F.format_string(f"%.{digits}f", x), "-.", "mp") for x in (lat, lon)]


def _slug(name) -> Column:
    return F.coalesce(F.nullif(slugify(name), F.lit("")), F.lit("field"))


def stable_id(country, code, name, lat, lon) -> Column:
    """Country, code where it is a plain one, name and position in one key."""
    plain = F.when(F.regexp_like(F.upper(code), F.lit("^[A-Z0-9]{3,5}$")), F.lower(code))
    land = F.coalesce(F.nullif(F.lower(country), F.lit("")), F.lit("xx"))
    return F.concat_ws("_", land, plain, F.substring(_slug(name), 1, 48), *_at(lat, lon, 4))


def mint_code(country, name, lat, lon) -> Column:
    """A code for a field without one."""
    return F.upper(F.concat_ws("_", country, F.substring(_slug(name), 1, 24), *_at(lat, lon, 3)))


def note_value(notes, labels: list[str]) -> Column:
    """The first clause after a label that begins a line of the notes, at most 40 characters; else empty."""
    line = F.regexp_extract(F.coalesce(notes, F.lit("")), rf"(?imu)^\s*(?:{'|'.join(labels)})\s*:\s*(.+)$", 1)
    return F.substring(norm_space(F.trim(F.split(line, "[.;\n]")[0])), 1, 40)


def cup_description(difficulty, notes, heading, length, width, freq) -> Column:
    """Grade, runway, surface and frequency of a waypoint, what is known of them."""
    whole = lambda x: F.floor(x + 0.5).cast("string")
    way = F.coalesce(F.nullif(note_value(notes, ["Direction", "Richtung"]), F.lit("")), F.concat(F.lpad(whole(heading), 3, "0"), F.lit("°")))
    size = F.when((length > 0) & (width > 0), F.concat(whole(length), F.lit("×"), whole(width), F.lit(" m"))).when(length > 0, F.concat(whole(length), F.lit(" m")))
    grade = F.when(difficulty != "UNKNOWN", F.concat(F.lit("["), F.nullif(difficulty, F.lit("")), F.lit("]")))
    surface = F.nullif(note_value(notes, ["Surface", "Oberfläche", "Oberflaeche"]), F.lit(""))
    return F.concat_ws(" · ", grade, way, size, surface, F.concat(F.nullif(freq, F.lit("")), F.lit(" MHz")))


def note_source_lang(source) -> Column:
    """The language that a source writes in; null where unknown."""
    low = F.lower(clean(source))
    return F.when(F.regexp_like(low, F.lit("guide|planeur-net")), "fr").when(F.regexp_like(low, F.lit("openaip|sia|vac|aerodrome")), "en")


def parse_cycle_date(c) -> Column:
    """The date in ``260709``, ``/2026JUN25/``, ``09-JUL-26`` or ``_2026_07_09``; null without one."""
    def made(pattern, y, m, d):
        part = lambda i: F.regexp_extract(F.upper(c), pattern, i)
        month = F.coalesce(_map(MONTHS)[part(m)], part(m))
        return F.concat_ws("-", F.right(F.concat(F.lit("20"), part(y)), F.lit(4)), F.lpad(month, 2, "0"), part(d)).try_cast("date")

    return F.coalesce(
        made(r"^(\d{2})(\d{2})(\d{2})$", 1, 2, 3), made(r"/(\d{4})([A-Z]{3})(\d{2})/", 1, 2, 3),
        made(r"(\d{2})-([A-Z]{3})-(\d{2})", 3, 2, 1), made(r"_(\d{4})_(\d{2})_(\d{2})", 1, 2, 3),
    )


def crossing_clearance(alt, crit_elev, crit_at, ratio) -> Column:
    """Height over the critical point when the glide gets there; null where there is none."""
    left = alt - crit_elev - crit_at / ratio
    return F.when((alt > crit_elev) & (ratio > 0) & (left > 0), left)


def is_detour(path, distance, direct, times: float = 1.1) -> Column:
    return F.coalesce(~direct & (path > distance * times), F.lit(False))


def airac_dates(today, first: str = "2024-01-25", back: int = 365, ahead: int = 56) -> Column:
    """The publication dates, every 28 days, from a year back to 56 days ahead, the nearest first; the earlier of equals."""
    days = F.filter(F.sequence(F.lit(first).cast("date"), F.greatest(F.date_add(today, ahead), F.lit(first).cast("date")), F.expr("interval 28 days")), lambda d: d.between(F.date_sub(today, back), F.date_add(today, ahead)))
    return F.transform(F.array_sort(F.transform(days, lambda d: F.struct(F.abs(F.datediff(d, today)).alias("far"), d.alias("d")))), lambda x: x["d"])
