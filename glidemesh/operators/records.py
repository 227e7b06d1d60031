"""Joins and merges of records: frequencies, documents, notes, versions, routes and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glidemesh.functions import geo, text

RULE = "\n\n---\n\n"


def enrich_freqs(sites: DataFrame, freqs: DataFrame) -> DataFrame:
    """Sites with the frequencies ``(code, mhz)`` known for their code, ascending; empty without any."""
    found = freqs.where("code <> ''").groupBy(F.upper("code").alias("key")).agg(F.array_sort(F.collect_set(F.round("mhz", 3))).alias("mhz"))
    keyed = sites.withColumn("key", F.when(F.col("code") != "", F.upper("code")))
    return keyed.join(found, "key", "left").drop("key").withColumn("mhz", F.coalesce("mhz", F.array().cast("array<double>")))


def attach_documents(sites: DataFrame, docs: DataFrame) -> DataFrame:
    """Sites that have no document yet get that of their code; others keep theirs, so a second run changes nothing."""
    found = docs.groupBy("code").agg(F.min("doc").alias("found"))
    return sites.join(found, "code", "left").withColumn("doc", F.coalesce("doc", "found")).drop("found")


def apply_routes(answers: DataFrame, routes: DataFrame, solved: DataFrame, least: float = 0.98) -> DataFrame:
    """Answers with the ratio around terrain. A solved site without a route is blocked only where the
    terrain was covered and a direct ratio existed; else the direct one stands, unchecked."""
    on = ["fix_id", "src_seq"]
    j = answers.join(solved.select(*on, "coverage"), on, "left").join(routes.select(*on, "route_ratio"), on, "left")
    shut = F.col("coverage").isNotNull() & (F.col("coverage") >= least) & F.col("ratio").isNotNull()
    state = F.when(F.col("route_ratio").isNotNull(), "routed").when(shut, "blocked").when(F.col("coverage").isNotNull(), "unchecked")
    return j.withColumn("terrain", state).select(*on, F.when(F.coalesce(F.col("terrain") != "blocked", F.lit(True)), F.coalesce("route_ratio", "ratio")).alias("ratio"), "terrain")


def reconcile_versions(index: DataFrame, held: DataFrame) -> DataFrame:
    """What becomes of held files ``(key, version, hash)`` under an index of the same columns: current,
    adopt (same content), sweep (the key's current content is held too) or keep as a fallback."""
    want = index.select("key", F.col("version").alias("v"), F.col("hash").alias("h"))
    j = held.join(want, "key", "left")
    fresh = F.coalesce(F.col("version") == F.col("v"), F.lit(False))
    same = F.coalesce(F.col("hash") == F.col("h"), F.lit(False))
    j = j.withColumns({"fresh": fresh, "same": same})
    has = j.groupBy("key").agg(F.bool_or(F.col("fresh") | F.col("same")).alias("has"))
    state = F.when(F.col("fresh"), "current").when(F.col("same"), "adopt").when(F.col("has"), "sweep").otherwise("keep")
    return j.join(has, "key").select("key", "version", state.alias("state"))


def merge_notes(notes: DataFrame) -> DataFrame:
    """Notes ``(gid, src_seq, lang, note)`` of each group and language in order, those alike in their first 300 characters once."""
    n = notes.withColumn("note", text.clean(F.col("note"))).where("note <> ''").withColumn("key", text.match_name(F.substring("note", 1, 300)))
    one = n.groupBy("gid", "lang", "key").agg(F.min(F.struct("src_seq", "note")).alias("x"))
    return one.groupBy("gid", "lang").agg(F.array_sort(F.collect_list("x")).alias("x")).select("gid", "lang", F.array_join("x.note", RULE).alias("note"))


def merge_sources(rows: DataFrame) -> DataFrame:
    """Source names of each group in the order of their first record, and how many records it has."""
    one = rows.withColumn("source", text.clean(F.col("source"))).groupBy("gid", "source").agg(F.min("src_seq").alias("at"), F.count("*").alias("n"))
    names = F.array_sort(F.collect_list(F.when(F.col("source") != "", F.struct("at", "source"))))
    out = one.groupBy("gid").agg(names.alias("x"), F.sum("n").alias("merged"))
    return out.select("gid", F.when(F.size("x") > 0, F.array_join("x.source", " + ")).otherwise("merged sources").alias("name"), "merged")


def tiles_for_sites(sites: DataFrame, tiles: DataFrame, by: str) -> DataFrame:
    """Published tiles ``(lat0, lon0, bytes)`` in the bounding box of each group's sites, and their bytes."""
    box = sites.groupBy(by).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.sequence(F.ceil("lo_lat") - 1, F.ceil("hi_lat") - 1)
    cells = box.select(by, F.explode(rows).alias("lat0"), "lo_lon", "hi_lon").select(by, "lat0", F.explode(F.sequence(F.floor("lo_lon"), F.floor("hi_lon"))).alias("lon0"))
    return cells.join(tiles, ["lat0", "lon0"]).groupBy(by).agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"))


def geo_verdict(photos: DataFrame, radius_m: float) -> DataFrame:
    """Of each submission: whether all photos were taken at the field, and the first that was not, else the first.

    A photo's own position decides; the device's only ever speaks in favour.
    """
    far = lambda a, b: geo.haversine_m(F.col(a), F.col(b), F.col("field_lat"), F.col("field_lon"))
    own, dev = far("gps_lat", "gps_lon"), far("device_lat", "device_lon")
    source = F.when(own.isNotNull(), "exif").when(dev <= radius_m, "device").otherwise("none")
    p = photos.withColumns({"source": source, "d": F.floor(F.when(own.isNotNull(), own).when(dev <= radius_m, dev) + 0.5), "ok": F.coalesce(F.coalesce(own, dev) <= radius_m, F.lit(False))})
    shown = F.min_by(F.struct("source", "d"), F.struct("ok", "pos"))
    return p.groupBy("submission").agg(F.bool_and("ok").alias("verified"), shown.alias("x")).select("submission", "verified", "x.source", F.col("x.d").alias("distance_m"))


def local_refs(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Distinct local files that some columns name, of each pack; absolute addresses are not local."""
    refs = rows.select(by, F.explode(F.array(*cols)).alias("ref"))
    return refs.where("ref <> '' and not lower(ref) rlike '^https?:'").distinct()


def localize(notes: DataFrame, memory: DataFrame, langs: list[str]) -> DataFrame:
    """A note in every language: its own text in its own, else the remembered translation, else its text."""
    want = notes.select("id", F.col("lang").alias("src"), "text", F.explode(F.array(*map(F.lit, langs))).alias("lang"))
    tm = memory.groupBy("lang", "text").agg(F.min("translation").alias("translation"))
    j = want.join(tm, ["lang", "text"], "left")
    return j.select("id", "lang", F.when(F.col("lang") == F.col("src"), F.col("text")).otherwise(F.coalesce("translation", "text")).alias("text"))


def build_report(**parts: tuple[DataFrame, str]) -> DataFrame:
    """Rows per value of one column of each part, as ``(part, value, n)``."""
    counts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "value", "n") for k, (df, c) in parts.items()]
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


def extract_links(pages: DataFrame) -> DataFrame:
    """Links of HTML pages ``(page_id, url, html)`` with their cleaned text, resolved against the page's address."""
    pattern = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    parts = [F.regexp_extract_all("html", F.lit(pattern), F.lit(i)) for i in (1, 2)]
    one = pages.select("page_id", "url", F.posexplode(F.arrays_zip(parts[0].alias("href"), parts[1].alias("label"))).alias("place", "x"))
    href, root = F.col("x.href"), F.regexp_extract("url", "^(https?://[^/]+)", 1)
    full = F.when(F.regexp_like(href, F.lit("(?i)^[a-z]+:")), href).when(F.startswith(href, F.lit("/")), F.concat(root, href))
    full = F.coalesce(full, F.concat(F.regexp_extract("url", "^(.*/)", 1), href))
    return one.select("page_id", F.col("place").cast("long").alias("place"), full.alias("href"), text.strip_html(F.col("x.label")).alias("label"))


def unique_ids(rows: DataFrame, order: str, column: str = "id") -> DataFrame:
    """Rows whose ids that another row has before get their ordinal as a suffix, from ``_2`` on."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(order))
    numbered = rows.withColumn("_n", n)
    return numbered.withColumn(column, F.when(F.col("_n") > 1, F.concat(column, F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col(column))).drop("_n")
