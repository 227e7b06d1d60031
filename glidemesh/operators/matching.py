"""Contributions, searches, versions and gates over sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.operators.resolve import nearest_within


def resolve_contributions(contribs: DataFrame, sites: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """``(contrib_id, src_seq, how)``: by site id, else by a code that one site alone has, else the
    nearest site within the radius; ``how`` is null where none fits."""
    ids = sites.groupBy(F.col("site_id").alias("want_id")).agg(F.min("src_seq").alias("by_id"))
    codes = sites.where("code <> ''").groupBy(F.col("code").alias("want_code")).agg(F.count("*").alias("n"), F.min("src_seq").alias("by_code"))
    j = contribs.join(ids, "want_id", "left").join(codes.where("n = 1").drop("n"), "want_code", "left")
    left = j.where("by_id is null and by_code is null").select("contrib_id", "lat", "lon")
    near = nearest_within(left, sites, radius_m, "contrib_id").select("contrib_id", F.col("site.src_seq").alias("by_place"))
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_code").isNotNull(), "code").when(F.col("by_place").isNotNull(), "place")
    return j.join(near, "contrib_id", "left").select("contrib_id", F.coalesce("by_id", "by_code", "by_place").alias("src_seq"), how.alias("how"))


def search_sites(sites: DataFrame, query: str, limit: int = 80) -> DataFrame:
    """Sites whose folded name and code hold every word of the query, by name; a top-k list."""
    words = F.filter(F.split(F.lower(text.ascii_fold(F.lit(query))), r"\s+"), lambda w: w != "")
    held = F.lower(text.ascii_fold(F.concat_ws(" ", "name", "code")))
    return sites.where(F.forall(words, lambda w: F.contains(held, w))).orderBy("name", "src_seq").limit(limit)


def version_drift(synced: DataFrame, live: DataFrame) -> DataFrame:
    """``(path, drift)``: both versions known and different."""
    a, b = synced.select("path", F.col("hash").alias("a")), live.select("path", F.col("hash").alias("b"))
    return a.join(b, "path", "left").select("path", F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("drift"))


def states_match(before: DataFrame, now: DataFrame, by: str) -> DataFrame:
    """Per group whether every key of either state has equal values in both; null counts as empty."""
    a, b = before.select("path", by, F.col("hash").alias("a")), now.select("path", by, F.col("hash").alias("b"))
    same = F.coalesce("a", F.lit("")) == F.coalesce("b", F.lit(""))
    return a.join(b, ["path", by], "full").groupBy(by).agg(F.bool_and(same).alias("same"))


def gate(expected: DataFrame, held: DataFrame, by: str, ratio: float = 0.8) -> DataFrame:
    """Per group the rows expected and had; it passes with at least ``ratio`` of them, and not with none."""
    n = expected.groupBy(by).agg(F.count("*").alias("expected")).join(held.groupBy(by).agg(F.count("*").alias("got")), by, "left")
    got = F.coalesce("got", F.lit(0))
    return n.select(by, "expected", got.alias("got"), ((got > 0) & (got >= F.col("expected") * ratio)).alias("passes"))


def selection_census(editions: DataFrame, skip: str) -> DataFrame:
    """Documents kept and skipped of each code, by a pattern on their language."""
    return editions.groupBy("code").agg(
        F.count_if(~F.regexp_like("lang", F.lit(skip))).alias("kept"), F.count_if(F.regexp_like("lang", F.lit(skip))).alias("skipped")
    )


def sample_cells(points: DataFrame, cells: DataFrame, nodata: int = -32768) -> DataFrame:
    """The elevation under each point ``(tile, r, c)``; null off the raster and on missing cells."""
    j = points.join(cells.select("tile", "r", "c", "elev"), ["tile", "r", "c"], "left")
    return j.withColumn("elev", F.when(F.col("elev") != nodata, F.col("elev").cast("long")))


def note_for(notes: Column, lang: str) -> Column:
    """A note in a language, else in English, French or German: the first that is not blank."""
    return F.coalesce(*[F.nullif(notes[x], F.lit("")) for x in dict.fromkeys([lang, "en", "fr", "de"])])
