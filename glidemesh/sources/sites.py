"""Files of landing sites: waypoint files, airport tables, contributions, packs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.sources import quoted

#: Columns that are read of waypoint files, found by their names in the header. Fixed values.
WAYPOINTS = [
    "name", "code", "country", "lat", "lon", "elev", "style", "type", "rwdir", "rwlen", "rwwidth", "width", "rw_width", "desc", "comment",
    "userdata", "pics", "images", "files", "freq", "frequency", "frequence", "fréquence", "radio",
]
#: The header of written waypoint files.
HEADER = "name,code,country,lat,lon,elev,style,rwdir,rwlen,freq,desc"


def read_waypoints(spark: SparkSession, paths: list[str] | str, source: str) -> DataFrame:
    """The usable waypoints of files in the CUP format, one row each; ``line_no`` is the number of its
    first line in its file.

    Quoted fields may hold line ends, commas and doubled quotes; a file's splits are read apart (see
    ``quoted``). A header that runs into the first line is parted from it. Rows without a name or a
    position, and ``version=`` rows, are left out. Columns are found by the header's names; of two
    with one name the last counts.
    """
    found = quoted.records(quoted.file_lines(spark, paths))
    head = found.where("line_no = 0").select("path", F.regexp_replace("record", '(?s)pics *"?version=.*$', "pics").alias("record"))
    head = head.select("path", F.transform(quoted.fields(F.col("record")), lambda x: F.lower(F.trim(x))).alias("head"))
    values = lambda x: F.regexp_replace(x, r'^\s+|\s+$', "")
    rows = found.where("line_no > 0").join(head, "path").withColumn("v", quoted.fields(F.col("record")))
    place = {c: F.array_position(F.reverse("head"), c) for c in WAYPOINTS}
    # a name at place k from the end is the (size - k)-th column; a short row has fewer values
    at = {c: F.coalesce(F.when(k > 0, text.clean(values(F.get("v", (F.size("head") - k).cast("int"))))), F.lit("")) for c, k in place.items()}
    rows = rows.select("path", "line_no", *[v.alias(c) for c, v in at.items()])
    some = lambda *cs: F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in cs])
    notes = F.coalesce(F.nullif("desc", F.lit("")), "comment")
    width = F.coalesce(*[F.nullif(text.parse_length_m(F.col(c)), F.lit(0.0)) for c in ("rwwidth", "width", "rw_width")], text.parse_width_m(some("desc", "comment", "userdata")))
    return (
        rows.select(
            "path", "line_no", "name", "code", "country",
            F.round(text.parse_coord(F.upper("lat"), True), 7).alias("lat"), F.round(text.parse_coord(F.upper("lon"), False), 7).alias("lon"),
            text.parse_length_m(F.col("elev")).alias("elev_m"), text.parse_length_m(F.col("rwlen")).alias("length_m"), width.alias("width_m"),
            text.parse_float(F.nullif("rwdir", F.lit(""))).alias("heading_deg"),
            text.raw_difficulty(F.concat_ws(" ", notes, "userdata", "type"), F.col("style")).alias("raw_difficulty"),
            text.strip_tags(notes).alias("notes"), text.media_refs(some("pics", "images", "files")).alias("media_refs"), F.lit(source).alias("source"),
            some("freq", "frequency", "frequence", "fréquence", "radio", "userdata", "comment", "desc").alias("radio_text"),
        )
        .where("name <> '' and lower(name) not like 'version=%' and lat is not null and lon is not null")
        .withColumns({"difficulty": text.grade(F.col("raw_difficulty")), "kind": text.site_kind(F.col("raw_difficulty"), F.col("code")), "frequencies": text.labelled_frequencies(F.col("radio_text"))})
        .drop("radio_text")
    )


def waypoint_lines(sites: DataFrame, lang: str = "en") -> DataFrame:
    """``(pack_id, kind, name, line)``: each site as a line of the CUP format."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("string")
    some = lambda c, unit: F.coalesce(F.when(F.col(c) > 0, F.concat(whole(c), F.lit(unit))), F.lit(""))
    line = F.concat_ws(
        ",",
        quote(F.trim(F.regexp_replace("name", r"^#?\d+\s+", ""))), quote(text.display_code(F.col("code"))), F.substring(F.coalesce("country", F.lit("")), 1, 2),
        text.format_cup_coord(F.col("lat"), True), text.format_cup_coord(F.col("lon"), False),
        F.coalesce(F.concat(whole("elev_m"), F.lit("m")), F.lit("")), F.when(F.col("kind") == "airfield", "5").otherwise("3"),
        F.coalesce(whole("heading_deg"), F.lit("")), some("length_m", "m"), F.coalesce("frequency", F.lit("")), quote(F.col("description")),
    )
    return sites.where("lat is not null and lon is not null").select("pack_id", "kind", "name", line.alias("line"))


def export_waypoints(lines: DataFrame, folder: str) -> None:
    """Waypoint files that other programs open: a folder a pack, every file with the header first.

    Packs are split by ranges of names where they are large, so no task writes all of one.
    """

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        for batch in batches:
            out = []
            for pack, line in zip(batch["pack_id"].to_pylist(), batch["line"].to_pylist()):
                if (pack,) != last:
                    out.append((pack, HEADER))
                    last = (pack,)
                out.append((pack, line))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["pack_id", "line"])

    dealt = lines.repartitionByRange("pack_id", "name").sortWithinPartitions("pack_id", "name").select("pack_id", "line")
    files = dealt.mapInArrow(headed, "pack_id string, line string")
    # a file limit would cut a file after its header
    files.write.partitionBy("pack_id").option("lineSep", "\r\n").option("maxRecordsPerFile", 0).mode("overwrite").text(folder)


def write_waypoints(lines: DataFrame, folder: str) -> None:
    """The bare lines without a header: one folder of text a pack, each site in the pack it was given to."""
    lines.select("pack_id", "line").repartition("pack_id").write.partitionBy("pack_id").option("lineSep", "\r\n").mode("overwrite").text(folder)


def write_packs(sites: DataFrame, folder: str) -> None:
    """One folder of JSON lines a pack, outlandings first, then by name."""
    dealt = sites.repartitionByRange("pack_id", (F.col("kind") == "airfield"), "name")
    order = dealt.sortWithinPartitions("pack_id", (F.col("kind") == "airfield").cast("int"), "name", "src_seq")
    order.write.partitionBy("pack_id").mode("overwrite").json(folder)


def read_contributions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(contributions, broken)``: every JSON file below a folder with its path, and those that do not
    parse or are no objects.

    ``photos`` has those under ``photoAssets`` and then the single ``photoAsset`` of older files;
    ``proposed`` is what a new site is proposed with, null where nothing is.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parsed = files.withColumn("v", F.try_parse_json("value"))
    object_ = F.startswith(F.trim("value"), F.lit("{"))
    good = parsed.where(F.col("v").isNotNull() & object_)
    get = lambda p, t: F.try_variant_get("v", p, t)
    photo = "struct<url:string,name:string>"
    assets = F.coalesce(get("$.photoAssets", f"array<{photo}>"), F.array().cast(f"array<{photo}>"))
    one = get("$.photoAsset", photo)
    photos = F.filter(F.concat(assets, F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast(f"array<{photo}>"))), lambda x: text.clean(x.url) != "")
    number = lambda p: text.parse_float(get(p, "string"))
    own = {"name": "name", "kind": "kind", "country": "country", "difficulty": "difficulty", "runway": "runway", "surface": "surface", "frequency": "frequency"}
    sizes = {"lat": "latitude", "lon": "longitude", "elev_m": "elevationM", "length_m": "lengthM", "width_m": "widthM"}
    proposed = F.struct(*[get(f"$.proposed.{k}", "string").alias(c) for c, k in own.items()], *[number(f"$.proposed.{k}").alias(c) for c, k in sizes.items()])
    out = good.select(
        "path", get("$.fieldId", "string").alias("site_id"), get("$.fieldCode", "string").alias("code"), get("$.fieldName", "string").alias("name"),
        get("$.fieldLat", "double").alias("lat"), get("$.fieldLon", "double").alias("lon"), get("$.description", "string").alias("description"),
        get("$.date", "string").alias("date"), get("$.submitter", "string").alias("submitter"), get("$.type", "string").alias("type"),
        get("$.submittedAt", "string").alias("submitted_at"), get("$.submitter.handle", "string").alias("handle"), photos.alias("photos"),
        F.when(get("$.proposed", "variant").isNotNull() & (get("$.type", "string") == "new-field"), proposed).alias("proposed"),
    )
    return out, parsed.where(F.col("v").isNull() | ~object_).select("path")


def read_airport_json(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, place, raw)``: every record of JSON files as its own text.

    A file is a list of records, a feature collection, an object that has such a list under one of
    some keys, or else one record. What is no object is left out. A file is one row until its records
    are dealt out, as its outline is told from all of it.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    keys = ["items", "data", "results", "airports", "features"]
    box = F.from_json("value", "type string, " + ", ".join(f"{k} array<string>" for k in keys))
    first = F.when(box["type"] == "FeatureCollection", box["features"])
    listed = F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.coalesce(first, *[box[k] for k in keys], F.array("value")))
    each = files.select("path", F.posexplode(listed).alias("place", "raw"))
    return each.where(F.startswith(F.trim("raw"), F.lit("{")))


def _table(spark: SparkSession, paths: list[str] | str, columns: str, code: str, countries: list[str]) -> DataFrame:
    """Rows of a CSV table whose code is one of the countries'; columns are found by the header, all read as texts."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(paths)
    kept = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(c) for c in columns.split()])
    return kept.withColumn("code", F.upper(text.clean(F.col(code)))).where(text.is_country_icao(F.col("code"), countries))


def _metres(feet: str) -> Column:
    return F.bround(text.parse_float(text.clean(F.col(feet))) * 0.3048, 1)


def read_airports(spark: SparkSession, paths: list[str] | str, countries: list[str]) -> DataFrame:
    """Airports with a position, one row a code: where a code stands twice, the one of the greater id counts."""
    rows = _table(spark, paths, "id ident name latitude_deg longitude_deg elevation_ft type iso_country", "ident", countries)
    filled = lambda c, other: F.coalesce(F.nullif(text.clean(F.col(c)), F.lit("")), other)
    found = rows.select(
        "code", filled("name", F.col("code")).alias("name"), text.parse_float(text.clean(F.col("latitude_deg"))).alias("lat"),
        text.parse_float(text.clean(F.col("longitude_deg"))).alias("lon"), _metres("elevation_ft").alias("elev_m"),
        filled("type", F.lit("airport")).alias("type"), filled("iso_country", F.lit("FR")).alias("country"), F.col("id").try_cast("long").alias("seq"),
    ).where("lat is not null and lon is not null")
    kept = [c for c in found.columns if c not in ("code", "seq")]
    return found.groupBy("code").agg(F.max(F.struct("seq", *kept)).alias("x")).select("code", *[f"x.{c}" for c in kept])


def read_runways(spark: SparkSession, paths: list[str] | str, countries: list[str]) -> DataFrame:
    """The longest runway of each code, the first of equals by its id."""
    rows = _table(spark, paths, "id airport_ident length_ft width_ft le_ident le_heading_degT", "airport_ident", countries)
    number = lambda c: text.parse_float(text.clean(F.col(c)))
    known = rows.withColumns({"feet": number("length_ft"), "seq": F.col("id").try_cast("long")}).where("feet is not null")
    kept = F.struct(_metres("length_ft").alias("length_m"), _metres("width_ft").alias("width_m"), number("le_heading_degT").alias("heading_deg"), text.clean(F.col("le_ident")).alias("runway"))
    return known.groupBy("code").agg(F.max_by(kept, F.struct("feet", -F.col("seq"))).alias("x")).select("code", "x.*")


def read_frequencies(spark: SparkSession, paths: list[str] | str, countries: list[str]) -> DataFrame:
    """Radio frequencies of each code between 118 and 137 MHz."""
    rows = _table(spark, paths, "airport_ident frequency_mhz type description", "airport_ident", countries)
    mhz = text.parse_float(text.clean(F.col("frequency_mhz")))
    return rows.where(mhz.between(118, 137)).select("code", F.round(mhz, 3).alias("mhz"), text.clean(F.col("type")).alias("type"), text.clean(F.col("description")).alias("description"))


def snapshot_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, hash, size)`` of every file below a folder: path from there, 16 digits of its content's SHA-1.

    Spark's scan passes over files without content, so they are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inner = F.substring_index("path", folder.rstrip("/").split("://")[-1].lstrip("/") + "/", -1)
    return files.select(inner.alias("path"), F.substring(F.sha1("content"), 1, 16).alias("hash"), F.col("length").alias("size"))


def read_cols(elements: DataFrame) -> DataFrame:
    """``(name, lat, lon, elev_m)`` of map nodes ``(seq, name, lat, lon, ele)`` that have a name and a position.

    One place is often mapped twice, so of those at one position, to 1/2000 degree, the first counts.
    Heights are numbers with or without commas and a unit of metres; others are unknown.
    """
    tidy = F.trim(F.replace(F.replace(F.trim("ele"), F.lit(","), F.lit("")), F.lit("m"), F.lit("")))
    name = F.trim(F.coalesce("name", F.lit("")))
    named = elements.where((name != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    spot = [F.bround(F.col(c) * 2000).cast("long").alias(f"_{c}") for c in ("lat", "lon")]
    row = F.struct("seq", name.alias("name"), F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"), F.bround(tidy.try_cast("double")).cast("long").alias("elev_m"))
    return named.groupBy(*spot).agg(F.min(row).alias("x")).select("x.name", "x.lat", "x.lon", "x.elev_m")


def pack_index(manifests: DataFrame) -> DataFrame:
    """Packs in their published order with what a picker shows."""
    return manifests.select("pack_rank", "pack_id", F.concat(F.lit("packs/"), "pack_id", F.lit("/manifest.json")).alias("manifest"), "sites", "bytes").orderBy("pack_rank")


#: Submissions: countries that are taken. A fixed value.
COUNTRIES = ["FR", "CH", "DE", "IT", "AT"]


#: Submissions: what a photo may be, and the characters that are kept of a proposal's texts. Fixed values.
PHOTO_TYPE, PHOTO_BYTES, PHOTO_EDGE = "image/jpeg", 15_728_640, 2_560
CLIPS = {"runway": 20, "surface": 60, "frequency": 20}


def check_submissions(df: DataFrame, countries: list[str] | None = None, most_photos: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` of submissions ``(type, name, lat, lon, country, site_id, description, photos)``.

    Numbers are texts as they were sent; a blank one is none, and so is one that is not finite. Rejected
    rows say why, the first reason found. With ``photo_files``, an array of structs of type, bytes and
    long_edge (pixels, null: unknown), the first photo that is no JPEG, too large or too small tells.
    Accepted proposals have their texts clipped (name, and of runway, surface, frequency, difficulty,
    elev_m, length_m, width_m those that there are), a grade of A to C or none, and numbers or null.
    """

    def number(c: str) -> Column:
        v = F.trim(c).try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)

    new, lat, lon = F.col("type") == "new-field", number("lat"), number("lon")
    name = F.trim(F.substring(F.trim(F.coalesce("name", F.lit(""))), 1, 80))
    inside = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    photo = F.lit(None).cast("string")
    if "photo_files" in df.columns:
        wrong = F.transform(
            "photo_files",
            lambda x: F.when(F.coalesce(x.type, F.lit("")) != PHOTO_TYPE, "photo-type").when(x.bytes > PHOTO_BYTES, "photo-size").when(x.long_edge < PHOTO_EDGE, "photo-edge"),
        )
        photo = F.get(F.array_compact(wrong), 0)
    reason = (
        F.when(new & (F.length(name) < 3), "name")
        .when(new & ~inside, "coordinates")
        .when(new & ~F.coalesce(F.upper(F.trim("country")).isin(countries or COUNTRIES), F.lit(False)), "country")
        .when(~new & ((F.coalesce(F.trim("site_id"), F.lit("")) == "") | lat.isNull() | lon.isNull()), "reference")
        .when(F.coalesce("photos", F.lit(0)) > most_photos, "photos")
        .when(~new & (F.coalesce(F.trim("description"), F.lit("")) == "") & (F.coalesce("photos", F.lit(0)) == 0), "empty")
        .otherwise(photo)
    )
    told = df.withColumn("reason", reason)
    level = F.upper(F.trim("difficulty")) if "difficulty" in df.columns else None
    tidy = {"name": name, "lat": lat, "lon": lon, "country": F.upper(F.trim("country"))}
    tidy |= {c: F.substring(F.trim(c), 1, n) for c, n in CLIPS.items() if c in df.columns}
    tidy |= {c: number(c) for c in ("elev_m", "length_m", "width_m") if c in df.columns}
    tidy |= {} if level is None else {"difficulty": F.when(level.isin("A", "B", "C"), level).otherwise("")}
    good = told.where("reason is null").drop("reason").withColumns(tidy)
    return good, told.where("reason is not null")
