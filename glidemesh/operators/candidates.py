"""Which airports and codes a build takes: relevance, known codes, codes that still lack documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.functions.records import GLIDER_WORDS, is_relevant


def _code(c: str):
    return F.upper(text.clean(F.col(c)))


def pick_candidates(records: DataFrame, known: DataFrame, mode: str, types: list[int], words: list[str] = GLIDER_WORDS) -> DataFrame:
    """``records(raw, code)`` that are taken, with ``why``: ``all`` takes every one, ``glider`` those whose
    type or text says so, ``pack`` none; whatever the mode, those whose code is among ``known(code)``
    (``known``), if nothing else takes them. Blank codes are known nowhere."""
    if mode not in ("all", "glider", "pack"):
        raise ValueError(f"mode {mode!r} is none of all, glider, pack")
    codes = known.select(_code("code").alias("_code")).where("_code <> ''").distinct().withColumn("_known", F.lit(True))
    own = F.lit("all") if mode == "all" else F.when(is_relevant(F.col("raw"), types, words), "relevant") if mode == "glider" else F.lit(None)
    j = records.withColumn("_code", _code("code")).join(codes, "_code", "left")
    return j.withColumn("why", F.coalesce(own, F.when(F.col("_known"), "known"))).where("why is not null").drop("_code", "_known")


def pending_codes(sites: DataFrame, documents: DataFrame, restrict: DataFrame | None = None) -> DataFrame:
    """``(code, sites, without)``: codes, of those in ``restrict(code)`` if it is given, of which some site
    ``(src_seq, code)`` has no document in ``documents(src_seq)`` yet."""
    s = sites.select("src_seq", _code("code").alias("code")).where("code <> ''")
    if restrict is not None:
        s = s.join(restrict.select(_code("code").alias("code")).distinct(), "code", "left_semi")
    held = documents.select("src_seq").distinct().withColumn("_held", F.lit(1))
    n = s.join(held, "src_seq", "left").groupBy("code").agg(F.count("*").alias("sites"), F.count_if(F.col("_held").isNull()).alias("without"))
    return n.where("without > 0")


def probe_codes(sites: DataFrame, extra: DataFrame, airports: DataFrame, pattern: str, restrict: DataFrame | None = None) -> DataFrame:
    """``code``: the codes to ask a publisher for, each once: those of sites and of ``extra(code)``, and of
    ``airports(code, candidate)`` unless told otherwise there, that match a pattern and are not left out
    by ``restrict(code)``."""
    asked = airports.where(F.coalesce("candidate", F.lit(True))).select(_code("code").alias("code"))
    every = sites.select(_code("code").alias("code")).union(extra.select(_code("code").alias("code"))).union(asked)
    every = every.where(F.regexp_like("code", F.lit(f"^(?:{pattern})$"))).distinct()
    return every if restrict is None else every.join(restrict.select(_code("code").alias("code")).distinct(), "code", "left_semi")


def make_airfields(airports: DataFrame, runways: DataFrame, freqs: DataFrame) -> DataFrame:
    """Airports ``(src_seq, ...)`` with their longest runway's columns (the first of equals) and
    ``frequencies``, the distinct ``struct<mhz, type>`` between 118 and 137 MHz in the order they are
    listed, the first of one frequency; empty where there are none. A list holds one airport's."""
    keep = [c for c in runways.columns if c not in ("airport", "src_seq")]
    longest = runways.where("length_m is not null").groupBy(F.col("airport").alias("src_seq")).agg(F.max_by(F.struct(*keep), F.struct("length_m", -F.col("src_seq"))).alias("r"))
    heard = freqs.where("mhz between 118 and 137").groupBy("airport", F.round("mhz", 3).alias("mhz")).agg(F.min(F.struct("src_seq", "type")).alias("f"))
    listed = heard.groupBy(F.col("airport").alias("src_seq")).agg(F.array_sort(F.collect_list(F.struct("f.src_seq", "mhz", "f.type"))).alias("l"))
    out = airports.join(longest, "src_seq", "left").join(listed, "src_seq", "left")
    frequencies = F.coalesce(F.transform("l", lambda x: F.struct(x.mhz.alias("mhz"), x.type.alias("type"))), F.array().cast("array<struct<mhz:double,type:bigint>>"))
    return out.select(*airports.columns, "r.*", frequencies.alias("frequencies"))


def publish_index(manifests: DataFrame) -> DataFrame:
    """Packs ``(pack_rank, pack_id, name, names, hidden, bytes, sites)`` in their published order with what
    a picker shows; ``hidden`` is false unless it is said."""
    return manifests.select(
        "pack_rank", F.col("pack_id").alias("id"), F.col("name"), F.col("names"), F.coalesce("hidden", F.lit(False)).alias("hidden"),
        F.concat(F.lit("packs/"), "pack_id", F.lit("/manifest.json")).alias("manifest_url"), F.col("bytes").alias("size_bytes"), F.col("sites").alias("fields_count"),
    ).orderBy("pack_rank", "id")
