"""Contributions of pilots: proposals of new sites, reports and photos."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import asin, cos, degrees, floor, pi, radians, sin, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glidemesh.functions import geo, text
from glidemesh.operators.records import RULE, localize
from glidemesh.operators.resolve import cell_of, cells_around, ensure_checkpoints, near_pairs

#: What a report is headed with in each language, and what a photo is.
REPORT = {"en": "Pilot report", "fr": "Rapport pilote", "de": "Pilotenbericht"}
PHOTO = "Pilot photo"
SOURCE = "Community contribution"


class _Nearby:
    """Points on a sphere by cubes a radius wide: is one of them within the radius?"""

    def __init__(self, radius_m: float):
        self.radius_m, self.side, self.cubes = radius_m, 2 * sin(min(radius_m / geo.EARTH_M / 2, pi / 2)), defaultdict(list)

    def _cube(self, la: float, lo: float) -> tuple[int, int, int]:
        return floor(cos(la) * cos(lo) / self.side), floor(cos(la) * sin(lo) / self.side), floor(sin(la) / self.side)

    def add(self, la: float, lo: float) -> None:
        self.cubes[self._cube(la, lo)].append((la, lo))

    def has(self, la: float, lo: float) -> bool:
        x, y, z = self._cube(la, lo)
        for i in (0, -1, 1):
            for j in (0, -1, 1):
                for k in (0, -1, 1):
                    for a, o in self.cubes.get((x + i, y + j, z + k), ()):
                        h = sin((a - la) / 2) ** 2 + cos(la) * cos(a) * sin((o - lo) / 2) ** 2
                        if 2 * geo.EARTH_M * asin(sqrt(min(h, 1.0))) <= self.radius_m:
                            return True
        return False


def _decide(left: DataFrame, radius_m: float, step: float) -> DataFrame:
    """``(id, lat, lon, kept)`` of the points that their tile of ``step`` degrees keeps, or (``kept``
    false) cannot decide on, as that hangs on earlier points beyond its edge."""
    tile = cell_of(F.col("lat"), F.col("lon"), step)
    each = left.withColumn("own", tile).withColumn("g", F.explode(cells_around(F.col("lat"), F.col("lon"), radius_m, step)))
    each = each.select("g", (F.col("g") == F.col("own")).alias("mine"), "id", "lat", "lon")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, unsure = None, _Nearby(radius_m), _Nearby(radius_m)
        for batch in batches:
            out = []
            for g, mine, i, lat, lon in zip(*(batch[c].to_pylist() for c in ("g", "mine", "id", "lat", "lon"))):
                if g != now:
                    now, kept, unsure = g, _Nearby(radius_m), _Nearby(radius_m)
                la, lo = radians(lat), radians(lon)
                if kept.has(la, lo):
                    continue
                # a point of another tile may be kept or not: that is not seen from here
                sure = mine and not unsure.has(la, lo)
                (kept if sure else unsure).add(la, lo)
                if mine:
                    out.append((i, lat, lon, sure))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["id", "lat", "lon", "kept"])

    dealt = each.repartition("g").sortWithinPartitions("g", "id", "lat", "lon")
    return dealt.mapInArrow(run, "id long, lat double, lon double, kept boolean")


def first_come(points: DataFrame, radius_m: float, tile_m: float = 32_000.0) -> DataFrame:
    """The ``id`` of points ``(id, lat, lon)`` that are kept if they come in the order of their ids
    and each is kept unless one kept before is within the radius.

    Each tile takes its points in order, with those just beyond its edge, and decides on all but the
    ones that hang on what is beyond. What is near a kept point goes; the rest, along the edges, is
    decided in tiles four times as wide, the last of them the globe: so the rounds are few and the
    same for any chain of points, however long. A task reads its tiles' points as a stream and holds
    the kept and undecided ones, so a crowd around a kept point costs no pairs and no memory. Points
    at one place count as their first; those without a position are left out.
    """
    ensure_checkpoints(points.sparkSession)
    left = points.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("id").cast("long").alias("id")).select("id", "lat", "lon")
    left, out, step = left.checkpoint(), points.select("id").limit(0), degrees(tile_m / geo.EARTH_M)
    while not left.isEmpty():
        found = _decide(left, radius_m, step if step < 90 else 360.0).checkpoint()
        new, rest = found.where("kept"), found.where("not kept").select("id", "lat", "lon")
        out = out.union(new.select("id"))
        left = rest.join(near_pairs(new, rest, radius_m).select("y.id").distinct(), "id", "left_anti").checkpoint()
        step *= 4
    return out


def triage_proposals(proposals: DataFrame, sites: DataFrame, radius_m: float = 300.0, first: bool = False) -> DataFrame:
    """What becomes of proposals ``(contrib_id, name, lat, lon, field_id, kind, difficulty, country)``,
    which come in the order of ``contrib_id``.

    ``how`` is ``bad`` (no name or position), ``update`` (``src_seq`` is the nearest site within the
    radius), ``again`` (``first_id`` is the nearest proposal that made a site before, no site being
    nearer) or ``new``, with an ``id`` from its name and position that stays the same in every build.
    Of equally near ones the last counts, of proposals the ``first`` on request. Grades are A to C, else unknown. Positions go into ids with
    four decimals, halves rounded up.
    """
    named = proposals.withColumn("_ok", (text.clean(F.col("name")) != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    good = named.where("_ok").select(F.col("contrib_id").alias("id"), "lat", "lon")
    known = near_pairs(good, sites.select("src_seq", "lat", "lon"), radius_m, spread="right").groupBy(F.col("x.id").alias("id"))
    known = known.agg(F.max_by("y.src_seq", F.struct(-F.col("d"), "y.src_seq")).alias("src_seq"), F.min("d").alias("site_d"))
    free = good.join(known, "id", "left_anti")
    new = first_come(free, radius_m)
    made = near_pairs(good, free.join(new, "id"), radius_m).where("y.id < x.id").groupBy(F.col("x.id").alias("id"))
    made = made.agg(F.max_by("y.id", F.struct(-F.col("d"), -F.col("y.id") if first else F.col("y.id"))).alias("first_id"), F.min("d").alias("made_d"))
    j = named.join(known.withColumnRenamed("id", "contrib_id"), "contrib_id", "left").join(made.withColumnRenamed("id", "contrib_id"), "contrib_id", "left")
    again = F.col("made_d").isNotNull() & (F.col("site_d").isNull() | (F.col("made_d") <= F.col("site_d")))
    how = F.when(~F.col("_ok"), "bad").when(again, "again").when(F.col("src_seq").isNotNull(), "update").otherwise("new")
    slug = text.slugify(F.coalesce(F.nullif(text.clean(F.col("field_id")), F.lit("")), text.clean(F.col("name"))))
    spot = F.substring(F.sha1(F.format_string("%.4f,%.4f", "lat", "lon")), 1, 6)
    level = F.upper(text.clean(F.col("difficulty")))
    is_new = F.col("how") == "new"
    return j.withColumn("how", how).select(
        "contrib_id",
        "how",
        F.when(F.col("how") == "update", F.col("src_seq")).alias("src_seq"),
        F.when(F.col("how") == "again", F.col("first_id")).alias("first_id"),
        F.when(is_new, F.concat(F.substring(slug, 1, 48), F.lit("-"), spot)).alias("id"),
        F.when(is_new, F.when(text.clean(F.col("kind")) == "airfield", "airfield").otherwise("outlanding")).alias("kind"),
        F.when(is_new, F.when(level.isin("A", "B", "C"), level).otherwise("UNKNOWN")).alias("difficulty"),
        F.when(is_new, F.upper(text.clean(F.col("country")))).alias("country"),
    )


def proposal_note(lat, lon, kind, difficulty, runway, length, width, surface, frequency, elev) -> Column:
    """What a proposal says in one line, for the note of the site that it became part of."""
    some = lambda c: F.nullif(text.clean(c), F.lit(""))
    whole = lambda c: F.bround(c).cast("long").cast("string")
    size = F.concat(whole(length), F.coalesce(F.when(width != 0, F.concat(F.lit("×"), whole(width))), F.lit("")), F.lit(" m"))
    return F.concat_ws(
        " · ",
        F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("@%.5f, %.5f", lat, lon)),
        some(kind),
        F.concat(F.lit("difficulty "), F.upper(some(difficulty))),
        F.concat(F.lit("Direction: "), some(runway)),
        F.when(length != 0, size),
        F.concat(F.lit("Surface: "), some(surface)),
        some(frequency),
        F.concat(F.lit("elev "), whole(elev), F.lit(" m")),
    )


def in_path_order(contribs: DataFrame) -> DataFrame:
    """``contribs`` with ``contrib_id``: whole numbers that rise with ``path``, with gaps. They are given
    once and written down, as they would not be the same in a second run."""
    ensure_checkpoints(contribs.sparkSession)
    return contribs.repartitionByRange("path").sortWithinPartitions("path").withColumn("contrib_id", F.monotonically_increasing_id()).checkpoint()


def proposals_of(contribs: DataFrame) -> DataFrame:
    """The rows of ``sources.sites.read_contributions`` that propose a site, as ``triage_proposals``
    takes them: with the proposal's own name and position, in the order of their paths."""
    p = contribs.where(F.coalesce("type", F.lit("")) == "new-field")
    own = ["kind", "difficulty", "country", "runway", "length_m", "width_m", "surface", "frequency", "elev_m"]
    return p.select("contrib_id", F.col("proposed.name").alias("name"), F.col("proposed.lat").alias("lat"), F.col("proposed.lon").alias("lon"), F.col("site_id").alias("field_id"), *[f"proposed.{c}" for c in own])


def fold_proposals(contribs: DataFrame, triaged: DataFrame) -> DataFrame:
    """``contribs`` for ``fold_contributions``: each with the site ``src_seq`` that it is for, and what a
    proposal says kept in its description where it became part of another site.

    Sites that proposals made are numbered below zero, ``-1 - contrib_id`` of the proposal that made
    them. A new site's own description and values are in the site, so it adds none here; bad
    proposals are for no site.
    """
    t = triaged.select(F.col("contrib_id"), "how", F.col("src_seq").alias("_site"), "first_id")
    j = contribs.join(t, "contrib_id", "left")
    p = lambda c: F.col(f"proposed.{c}")
    said = proposal_note(p("lat"), p("lon"), p("kind"), p("difficulty"), p("runway"), p("length_m"), p("width_m"), p("surface"), p("frequency"), p("elev_m"))
    with_data = F.concat_ws("\n", F.nullif(text.clean(F.col("description")), F.lit("")), F.concat(F.lit("Proposed field data: "), F.nullif(said, F.lit(""))))
    part = F.col("how").isin("update", "again")
    site = F.when(F.col("how") == "update", F.col("_site")).when(F.col("how") == "again", -1 - F.col("first_id")).when(F.col("how") == "new", -1 - F.col("contrib_id"))
    own = F.col("src_seq") if "src_seq" in contribs.columns else F.lit(None).cast("long")
    text_of = F.when(part, with_data).when(F.col("how") == "new", F.lit("")).otherwise(F.col("description"))
    return j.withColumns({"src_seq": F.when(F.col("how").isNotNull(), site).otherwise(own), "description": text_of}).drop("how", "_site", "first_id")


def _told(contribs: DataFrame) -> DataFrame:
    """Contributions with the day they are from and who sent them, in brackets, if known."""
    day = F.coalesce(F.nullif(text.clean(F.col("date")), F.lit("")), F.substring(text.clean(F.col("submitted_at")), 1, 10))
    who = F.nullif(text.clean(F.col("handle")), F.lit(""))
    return contribs.withColumns({"_day": day, "_who": F.coalesce(F.concat(F.lit(" ("), who, F.lit(")")), F.lit(""))})


def fold_contributions(contribs: DataFrame, notes: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(notes, rejected)``: the notes ``(src_seq, lang, note, added)`` of all sites that contributions
    ``(contrib_id, path, src_seq, date, submitted_at, handle, description)`` are for, and the
    contributions that no site was found for.

    A dated fragment for each, in the order of its path, goes after the site's own note (one row a
    language of ``notes(src_seq, lang, note)``), in every language: as remembered in
    ``memory(lang, text, translation)``, else as it was sent. Blank descriptions add nothing.
    """
    found = _told(contribs.where("src_seq is not null")).withColumn("_text", text.clean(F.col("description"))).where("_text <> ''")
    # a description that many sent is looked up once
    texts = found.select("_text").distinct().select(F.col("_text").alias("id"), F.lit(None).cast("string").alias("lang"), F.col("_text").alias("text"))
    said = localize(texts, memory, list(REPORT)).select(F.col("id").alias("_text"), "lang", "text")
    head = F.create_map(*[F.lit(x) for kv in REPORT.items() for x in kv])
    line = F.concat(head[F.col("lang")], F.lit(" "), "_day", "_who", F.lit(": "), "text")
    parts = found.join(said, "_text").select("src_seq", "lang", "path", "contrib_id", line.alias("line"))
    added = parts.groupBy("src_seq", "lang").agg(F.array_sort(F.collect_list(F.struct("path", "contrib_id", "line"))).alias("x"))
    own = notes.select("src_seq", "lang", F.nullif(F.col("note"), F.lit("")).alias("own"))
    j = added.join(own, ["src_seq", "lang"], "left")
    note = F.trim(F.concat_ws(RULE, "own", F.array_join("x.line", RULE)))
    return j.select("src_seq", "lang", note.alias("note"), F.size("x").cast("long").alias("added")), contribs.where("src_seq is null")


def contributed_photos(contribs: DataFrame, sites: DataFrame) -> DataFrame:
    """Media rows of contributions' ``photos`` (structs of name and url), in the order of path and place.

    Photos without an address are left out; one without a name is called after the file it came in.
    """
    each = _told(contribs.where("src_seq is not null")).select("path", "src_seq", "_day", "_who", F.posexplode("photos").alias("place", "photo")).where("photo.url <> ''")
    base = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    name = text.safe_filename(F.coalesce(F.nullif(text.clean(F.col("photo.name")), F.lit("")), F.concat(base, F.lit(".jpg"))))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return each.join(sites.select("src_seq", "site_id"), "src_seq").select(
        "src_seq",
        "path",
        "place",
        F.lit("image").alias("type"),
        F.concat(F.lit("media/"), "site_id", F.lit("/contrib-"), stem, F.lit(".jpg")).alias("url"),
        F.concat(F.lit(PHOTO + " · "), "_day", "_who").alias("caption"),
        F.lit(SOURCE).alias("source"),
        F.col("_day").alias("updated_at"),
    )
