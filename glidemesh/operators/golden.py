"""Golden records: one a group of records of the same place, each column by its own rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glidemesh.functions import records, text
from glidemesh.operators.records import merge_notes, merge_sources

#: How much a source's name counts for a record (those found add up), and for a name
#: (the first found); codes that are real ones; a word that is a known slip of the pen.
RECORD_SCORES = [("openaip", 40), ("sia", 30), ("guide|planeur-net", 20)]
NAME_SCORES = [("openaip", 100), ("sia", 90), ("guide|planeur-net", 70)]
REAL_CODE = "^(LF|LS|LI)[A-Z0-9]{2,4}$"
SLIP = r"(?i)\bcair\b"

NUMBERS = ["lat", "lon", "elev_m", "length_m", "width_m", "heading_deg"]


def record_quality(seq: str = "src_seq") -> Column:
    """How good a record is: source, completeness, frequencies, media, kind; then the earlier one."""
    low = F.lower(text.clean(F.col("source")))
    of_media = F.exists(F.coalesce("media", F.array()), lambda m: F.contains(F.lower(F.coalesce(m["source"], F.lit(""))), F.lit("sia")))
    source = sum((F.when(F.regexp_like(low, F.lit(p)) | (of_media if p == "sia" else F.lit(False)), n).otherwise(0) for p, n in RECORD_SCORES), F.lit(0))
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("code", "frequency")] + [F.col(c).isNotNull() for c in ("lat", "lon", "elev_m", "length_m")]
    return F.struct(
        source.alias("source"),
        sum((x.cast("int") for x in filled), F.lit(0)).alias("filled"),
        F.size(F.coalesce("freqs", F.array())).alias("freqs"),
        F.size(F.coalesce("media", F.array())).alias("media"),
        F.coalesce(F.col("kind") == "airfield", F.lit(False)).alias("airfield"),
        (-F.col(seq)).alias("seq"),
    )


def name_quality(shown: Column) -> Column:
    """How good a name is: an ``openaip`` one, then one without slips, codes and numbers, then by source."""
    low = F.lower(text.clean(F.col("source")))
    by_source = F.lit(0)
    for pattern, n in reversed(NAME_SCORES):
        by_source = F.when(F.regexp_like(low, F.lit(pattern)), n).otherwise(by_source)
    without = lambda p: ~F.regexp_like(shown, F.lit(p))
    return F.struct(
        F.contains(low, F.lit("openaip")).alias("openaip"),
        without(SLIP).alias("spelled"),
        without(r"(?i)\b(?:LF|LS|LI)[A-Z0-9]{2,4}\b").alias("no_code"),
        without(r"^#?\d+\b").alias("no_ordinal"),
        without(r"\b\d+\b").alias("no_number"),
        by_source.alias("source"),
        shown.alias("shown"),
    )


def merge_docs(grouped: DataFrame) -> DataFrame:
    """``(gid, docs)``: the documents of a group's records by key; the last record that has a key wins."""
    each = grouped.select("gid", "src_seq", F.explode("docs").alias("k", "v"))
    one = each.groupBy("gid", "k").agg(F.max_by("v", "src_seq").alias("v"))
    return one.groupBy("gid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("docs"))


def merge_fields(grouped: DataFrame) -> DataFrame:
    """One record a group of ``gid`` from records with ``src_seq``, texts, numbers and lists.

    Columns: name, code, country, kind, difficulty, raw_difficulty, source, frequency, the numbers
    above, ``freqs``, ``media`` (structs with a ``source``) and ``docs`` (a map). Nulls and blank
    texts tell nothing; a column that no record fills is null (numbers) or empty (texts). Best name
    and code go by their own scores; country and numbers come from the best record that has one;
    a country nobody names follows from the code; the kind is an airfield if any record says so; the
    worst grade stands; the raw grade is the first there is. Only maxima and minima are kept of a
    group, so its size does not matter.
    """
    code, raw = F.upper(text.clean(F.col("code"))), text.clean(F.col("raw_difficulty"))
    level = F.upper(text.clean(F.col("difficulty")))
    # in a column of its own, a name is made ready to show once, not for each test of it
    named = F.when(text.clean(F.col("name")) != "", name_quality(F.col("_shown")))
    q = F.col("_q")
    g = grouped.withColumn("_shown", text.clean_display_name(F.col("name"))).withColumns({"_q": record_quality(), "_name": named})
    rank = F.struct((~F.regexp_like(code, F.lit(REAL_CODE))).alias("made_up"), F.length(code).alias("n"), code.alias("code"))
    best = lambda c, has: F.max_by(F.when(has, F.col(c)), F.when(has, q)).alias(c)
    one = g.groupBy("gid").agg(
        F.coalesce(F.max("_name")["shown"], F.lit("")).alias("name"),
        F.coalesce(F.min(F.when(code != "", rank))["code"], F.lit("")).alias("code"),
        best("country", F.coalesce(F.col("country") != "", F.lit(False))),
        F.when(F.coalesce(F.bool_or(F.col("kind") == "airfield"), F.lit(False)), "airfield").otherwise("outlanding").alias("kind"),
        F.coalesce(F.max(F.when(level.isin("A", "B", "C", "D"), level)), F.lit("UNKNOWN")).alias("difficulty"),
        F.min(F.when(raw != "", F.struct("src_seq", raw.alias("raw"))))["raw"].alias("raw_difficulty"),
        *[best(c, F.col(c).isNotNull()) for c in NUMBERS],
    )
    one = one.withColumns(
        {
            "raw_difficulty": F.coalesce("raw_difficulty", "difficulty"),
            "country": F.coalesce("country", text.country_from_icao(F.col("code"))),
            "lat": F.round("lat", 7),
            "lon": F.round("lon", 7),
        }
    )
    at = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("lat", "lon")]
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("field"))
    whole = one.withColumn("id", records.stable_id(F.col("country"), F.col("code"), name, *at))
    sources = merge_sources(grouped).select("gid", F.col("name").alias("sources"), "merged")
    return whole.join(sources, "gid").join(merge_docs(grouped), "gid", "left")


#: The order in which frequencies are listed by what they are for, and how much the name
#: of their source counts (those found add up).
FREQ_ORDER = ["AFIS", "TWR", "CTAF", "ATF", "A/A", "UNICOM", "INFO", "RDO", "APP", "ATIS", "GND"]
FREQ_SCORES = [("sia|aip", 50), ("openaip", 40), ("guide|cup|planeur", 10)]


def merge_frequencies(grouped: DataFrame) -> DataFrame:
    """``(gid, frequencies, frequency)``: of each group's ``freqs`` (structs of mhz, type, description and
    source) and those found in the text ``frequency``, one of each frequency, the one of the best source,
    the first of equals; by use, then by frequency, and the first of them in short."""
    kind = "array<struct<mhz:double,type:string,description:string,source:string>>"
    mined = F.transform(
        text.labelled_frequencies(F.coalesce("frequency", F.lit(""))),
        lambda x: F.struct(x.mhz.alias("mhz"), x.type.alias("type"), F.lit("").alias("description"), F.col("source").alias("source")),
    ).cast(kind)
    held = F.transform("freqs", lambda x: F.struct(x.mhz.alias("mhz"), x.type.alias("type"), x.description.alias("description"), x.source.alias("source"))).cast(kind)
    each = grouped.select("gid", "src_seq", F.posexplode(F.concat(F.coalesce(held, F.array().cast(kind)), mined)).alias("pos", "f")).where("f.mhz is not null")
    low, told = F.lower(text.clean(F.col("f.source"))), lambda c: (text.clean(F.col(f"f.{c}")) != "").cast("int")
    score = sum((F.when(F.regexp_like(low, F.lit(p)), n).otherwise(0) for p, n in FREQ_SCORES), F.lit(0)) + 2 * told("type") + told("description")
    one = each.withColumn("mhz", F.round("f.mhz", 3)).groupBy("gid", "mhz").agg(F.max_by("f", F.struct(score.alias("s"), -F.col("src_seq"), -F.col("pos"))).alias("f"))
    said = F.upper(F.concat_ws(" ", text.clean(F.col("f.type")), text.clean(F.col("f.description"))))
    rank = F.coalesce(*[F.when(F.contains(said, F.lit(t)), i) for i, t in enumerate(FREQ_ORDER)], F.lit(len(FREQ_ORDER)))
    lists = one.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "mhz", "f.type", "f.description", "f.source"))).alias("l"))
    lists = lists.select("gid", F.transform("l", lambda x: F.struct(x.mhz.alias("mhz"), x.type.alias("type"), x.description.alias("description"), x.source.alias("source"))).alias("frequencies"))
    first = F.col("frequencies")[0]
    return lists.withColumn("frequency", text.format_freq(first["mhz"], text.clean(first["type"])))


def merge_media_items(grouped: DataFrame) -> DataFrame:
    """``(gid, media)``: a group's media, structs with a ``url``, the first of each address in their order."""
    each = grouped.select("gid", "src_seq", F.posexplode("media").alias("pos", "m")).withColumn("url", text.clean(F.col("m.url"))).where("url <> ''")
    one = each.groupBy("gid", "url").agg(F.min(F.struct("src_seq", "pos")).alias("at"), F.min_by("m", F.struct("src_seq", "pos")).alias("m"))
    lists = one.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("at", "url", "m"))).alias("l"))
    return lists.select("gid", F.transform("l", lambda x: x.m).alias("media"))


def whole_records(grouped: DataFrame) -> DataFrame:
    """``merge_fields`` with the groups' ``frequencies``, their short ``frequency``, ``media`` and ``notes``.

    ``freqs`` and ``media`` are arrays of structs (see above), ``notes`` maps of languages to texts; each
    language's notes are put together apart, those alike in their beginnings once. Lists are empty, maps
    and the short frequency null or empty where a group has none. A list holds one group's distinct items.
    """
    notes = merge_notes(grouped.select("gid", "src_seq", F.explode("notes").alias("lang", "note")))
    notes = notes.groupBy("gid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "note")))).alias("notes"))
    out = merge_fields(grouped).join(merge_frequencies(grouped), "gid", "left").join(merge_media_items(grouped), "gid", "left").join(notes, "gid", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType))
    return out.withColumns({"frequencies": empty("frequencies"), "media": empty("media"), "frequency": F.coalesce("frequency", F.lit(""))})
