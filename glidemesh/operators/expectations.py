"""Expectations on packs that are to be published: what is wrong with them, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages that a note must have. Fixed values.
LANGS = ("en", "fr", "de")
#: Rules and how bad a breach is.
RULES = {
    "manifest-id-missing": "warning", "manifest-id-differs": "warning", "fields-url-unusual": "warning", "fields-empty": "error",
    "key-missing": "error", "id-repeated": "error", "latitude": "error", "longitude": "error", "note-language-missing": "error",
    "media-url-missing": "error", "media-not-local": "warning", "media-escapes": "error", "media-missing": "warning", "media-missing-too-many": "error",
    "media-manifest-absent": "warning", "media-manifest-broken": "error", "media-version-differs": "error", "state-missing": "error",
}
OUT = ["pack", "rule", "severity", "key", "detail"]


def _breaches(df: DataFrame, key: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for every rule that a row breaks, all rules in one pass: ``{rule: (broken, detail)}``."""
    each = [F.struct(F.lit(r).alias("rule"), F.lit(RULES[r]).alias("severity"), F.coalesce(bad, F.lit(False)).alias("bad"), d.cast("string").alias("detail")) for r, (bad, d) in rules.items()]
    return df.select("pack", key.cast("string").alias("key"), F.explode(F.filter(F.array(*each), lambda x: x.bad)).alias("v")).select("pack", "v.rule", "v.severity", "key", "v.detail")


def resolved(folder: Column, url: Column) -> Column:
    """``folder/url`` from the root that holds the folders, without ``.`` and ``..``; null where the way
    leaves the root at any point, or begins at another."""
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), url), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(s: Column, x: Column) -> Column:
        up, n = x == "..", F.size(s.at)
        at = F.when(up, F.slice(s.at, 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.concat(s.at, F.array(x)))
        return F.struct(at.alias("at"), (s.out | (up & (n == 0))).alias("out"))

    end = F.aggregate(parts, start, step)
    return F.when(~F.startswith(url, F.lit("/")) & ~end.out, F.array_join(end.at, "/"))


def media_of(sites: DataFrame) -> DataFrame:
    """One row a media entry of ``sites``: its pack, key, address, kind and what the address means."""
    m = sites.select("pack", "key", F.explode("media").alias("m"))
    url = F.trim(F.coalesce("m.url", F.lit("")))
    remote = F.regexp_like(url, F.lit("^(http://|https://|data:)"))
    pdf = (F.lower(F.trim(F.coalesce("m.type", F.lit("")))) == "pdf") | F.endswith(F.lower(url), F.lit(".pdf"))
    return m.select("pack", "key", url.alias("url"), remote.alias("remote"), pdf.alias("pdf"), F.when((url != "") & ~remote, resolved(F.col("pack"), url)).alias("path"))


def check_packs(packs: DataFrame, sites: DataFrame, files: DataFrame, most_missing: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(breaches, counts)`` of packs that are to be published.

    ``packs``: pack (the folder's name), manifest_id, version, fields_url, and of what lies beside:
    has_media_manifest, media_manifest_ok, media_version, has_state. ``sites``: pack, pos, site_id,
    name, lat, lon (null: absent), notes (a map by language), media (an array of structs with url and
    type). ``files``: path of all files from the folder that holds the packs.

    Breaches have the pack, rule, severity (see ``RULES``), key (the site's id, or its place without
    one; the pack's name for rules on the pack) and a detail. Counts have sites, media, images, pdfs
    and missing files a pack; remote media and those without an address do not count, those that
    leave the folder do. A pack's first row with an id is no repetition.
    """
    place = F.col("pos").cast("string")
    known = sites.withColumn("key", F.coalesce(F.nullif(F.trim("site_id"), F.lit("")), place))
    value = {"id": "site_id", "name": "name", "latitude": "lat", "longitude": "lon"}
    absent = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(k)) for k, c in value.items()]))
    lacking = F.array_except(F.array(*map(F.lit, LANGS)), F.map_keys("notes"))
    within = lambda c, most: F.col(c).isNotNull() & ~(F.col(c).between(-most, most) & ~F.isnan(c))
    rows = _breaches(
        known,
        F.col("key"),
        {
            "key-missing": (F.size(absent) > 0, F.array_join(absent, ",")),
            "latitude": (within("lat", 90) | F.col("lat").isNull(), F.col("lat")),
            "longitude": (within("lon", 180) | F.col("lon").isNull(), F.col("lon")),
            "note-language-missing": (F.col("notes").isNotNull() & (F.size(lacking) > 0), F.array_join(lacking, ",")),
        },
    )
    # counted per id first, so no task has all rows of an id that many have
    ids = known.where(F.trim("site_id") != "").groupBy("pack", F.trim("site_id").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    again = _breaches(ids, F.col("key"), {"id-repeated": (F.lit(True), F.col("n") - 1)})

    media = media_of(known)
    held = media.join(files.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    local = (F.col("url") != "") & ~F.col("remote")
    gone = local & F.col("path").isNotNull() & F.col("there").isNull()
    shown = F.substring("url", 1, 120)
    of_media = _breaches(
        held,
        F.col("key"),
        {
            "media-url-missing": (F.col("url") == "", F.lit(None)),
            "media-not-local": (F.col("remote"), shown),
            "media-escapes": (local & F.col("path").isNull(), shown),
            "media-missing": (gone, shown),
        },
    )
    sums = held.groupBy("pack").agg(F.count_if(local).alias("media"), F.count_if(local & ~F.col("pdf")).alias("images"), F.count_if(local & F.col("pdf")).alias("pdfs"), F.count_if(gone).alias("missing"))
    each = sites.groupBy("pack").agg(F.count("*").alias("sites"))
    counts = packs.select("pack").join(each, "pack", "left").join(sums, "pack", "left").na.fill(0)

    told = packs.join(counts, "pack")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    no_id = F.coalesce("manifest_id", F.lit("")) == ""
    of_packs = _breaches(
        told,
        F.col("pack"),
        {
            "manifest-id-missing": (no_id, F.lit(None)),
            "manifest-id-differs": (~no_id & (F.col("manifest_id") != F.col("pack")), F.col("manifest_id")),
            "fields-url-unusual": ((F.coalesce("fields_url", F.lit("")) != "") & ~F.col("fields_url").isin("fields.json", "./fields.json"), F.col("fields_url")),
            "fields-empty": (F.col("sites") == 0, F.lit(None)),
            "media-missing-too-many": (F.col("missing") > most_missing, F.col("missing")),
            "media-manifest-absent": (~flag("has_media_manifest"), F.lit(None)),
            "media-manifest-broken": (flag("has_media_manifest") & ~flag("media_manifest_ok"), F.lit(None)),
            "media-version-differs": (flag("has_media_manifest") & flag("media_manifest_ok") & ~F.col("media_version").eqNullSafe(F.col("version")), F.col("media_version")),
            "state-missing": (~flag("has_state"), F.lit(None)),
        },
    )
    out = rows.unionByName(again).unionByName(of_media).unionByName(of_packs)
    return out.select(OUT), counts
