"""Translation memory over notes: segments, lookup, misses within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glidemesh.functions.text import trim_spaces, upper_each
from glidemesh.operators.totals import running_totals

#: Notes: documents' texts.
NOTES = "SELECT doc_id AS note_id, text FROM {documents}"
#: The segmentation in SQL, for comparison.
SEGMENTS_SQL = """SELECT note_id, i - 1 AS pos, lower(regexp_extract(trim(l[i]), '^[-*] |^', 0)) AS mark,
  trim(regexp_replace(trim(l[i]), '^[-*] ', '')) AS value
  FROM (SELECT note_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM ({notes}) n) x"""


def segments(df: DataFrame) -> DataFrame:
    """``(note_id, pos, mark, value)``: lines of notes, their bullet marker apart."""
    each = df.select("note_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = trim_spaces("line")
    return each.select(
        "note_id",
        F.col("pos").cast("long").alias("pos"),
        F.regexp_extract(line, "^([-*] )?", 1).alias("mark"),
        trim_spaces(F.regexp_replace(line, "^[-*] ", "")).alias("value"),
    )


def memory(conversations: DataFrame) -> DataFrame:
    """``(norm, translation)`` from the lines of all conversations."""
    lines = conversations.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select(trim_spaces("line").alias("norm")).distinct().withColumn("translation", upper_each(F.col("norm")))


def apply_memory(df: DataFrame, tm: DataFrame) -> DataFrame:
    """Each segment with its translation and state: cached, fallback (the source text) or blank."""
    hit = segments(df).join(tm.where("norm <> ''"), F.col("norm") == F.col("value"), "left")
    state = F.when(F.col("value") == "", "blank").when(F.col("norm").isNull(), "fallback").otherwise("cached")
    return hit.select("note_id", "pos", "mark", F.col("value").alias("text"), F.coalesce("translation", "value").alias("translated"), state.alias("state"))


def misses(df: DataFrame, tm: DataFrame, budget: int) -> DataFrame:
    """Distinct segments without translation, in reading order, while their characters fit the budget.

    ``first`` numbers the place: the note and, in it, the line, which is below 100,000 for lines of
    that many; it only tells where a segment was found first, the order is by note and line.
    """
    s = segments(df).where("value <> ''").join(tm, F.col("norm") == F.col("value"), "left_anti")
    one = s.groupBy("value").agg(F.min(F.struct("note_id", "pos")).alias("at")).select("at.note_id", "at.pos", F.length("value").cast("long").alias("chars"))
    out = running_totals(one, "note_id", ["pos"], "chars", budget)
    return out.select((F.col("note_id") * 100_000 + F.col("pos")).alias("first"), "chars", "total")


#: 'Label: value': a label of 24 characters at most, without a colon.
LABEL = r"^([^:]{1,24}):\s+(\S.*)$"
#: The same for Java's expressions, whose dot and end also stop at other line ends than a newline.
_LABEL = r"^([^:]{1,24}):[ \t\n\f\r]+([^ \t\n\f\r][^\n]*)\z"


def norm_space(text: "F.Column") -> "F.Column":
    return trim_spaces(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def parts(df: DataFrame) -> DataFrame:
    """``(note_id, pos, part, mark, value)``: what is looked up of each line; a label and its value apart."""
    both = F.array(F.concat(F.regexp_extract("value", _LABEL, 1), F.lit(":")), F.regexp_extract("value", _LABEL, 2))
    each = F.when(F.col("value").rlike(_LABEL), both).otherwise(F.array("value"))
    return segments(df).select("note_id", "pos", "mark", F.posexplode(each).alias("part", "value"))


def translate_notes(df: DataFrame, tm: DataFrame, langs: list[str]) -> DataFrame:
    """``(note_id, lang, text, whole, hits, fallbacks)`` of every note in every target language.

    A note that ``tm(lang, norm, translation)`` holds as a whole takes that translation; of others
    each line's parts are looked up, those without a translation stay as they are, and the lines
    are put together again in order. A null note has no row. Texts are looked up by their SHA-256.
    """
    digest = lambda c: F.unhex(F.sha2(c, 256))
    known = tm.where((F.col("norm") != "") & F.col("lang").isin(langs)).select(digest(F.col("norm")).alias("key"), F.struct("lang", "translation").alias("x"))
    known = known.groupBy("key").agg(F.collect_list("x").alias("found"))
    notes = df.where("text is not null").select("note_id", digest(norm_space(F.col("text"))).alias("key"))
    looked = notes.join(known, "key").select("note_id", F.explode("found").alias("x")).where("x.translation is not null")
    whole = looked.select(
        "note_id", "x.lang", F.col("x.translation").alias("text"), F.lit(True).alias("whole"), F.lit(1).cast("long").alias("hits"), F.lit(0).cast("long").alias("fallbacks")
    )
    said = whole.groupBy("note_id").agg(F.collect_set("lang").alias("said"))
    missing = F.filter(F.array(*map(F.lit, langs)), lambda x: ~F.coalesce(F.array_contains("said", x), F.lit(False)))
    rest = df.join(said, "note_id", "left").select(F.struct("note_id", missing.alias("langs")).alias("note_id"), "text").where(F.size("note_id.langs") > 0)
    each = parts(rest).select("note_id.*", "pos", "part", "mark", "value", digest(norm_space(F.col("value"))).alias("key"))
    # a note's parts come together before languages stand apart, so no text is shuffled for each of them
    each = each.join(known, "key", "left").drop("key").repartition("note_id").withColumn("lang", F.explode("langs"))
    told = F.transform(F.filter("found", lambda x: x.lang == F.col("lang")), lambda x: x.translation)
    each = each.withColumn("translation", F.explode_outer(F.when(F.size(told) > 0, told)))
    line = each.groupBy("note_id", "lang", "pos").agg(
        F.first("mark").alias("mark"),
        F.sort_array(F.collect_list(F.struct("part", F.coalesce("translation", "value").alias("t")))).alias("p"),
        F.count("translation").alias("hits"),
        F.count_if(F.col("translation").isNull() & (F.col("value") != "")).alias("fallbacks"),
    )
    line = line.withColumn("line", F.concat("mark", F.array_join("p.t", " ")))
    rest = line.groupBy("note_id", "lang").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("text"),
        F.lit(False).alias("whole"), F.sum("hits").alias("hits"), F.sum("fallbacks").alias("fallbacks"),
    )
    return whole.unionByName(rest)


def lang_misses(df: DataFrame, tm: DataFrame, langs: list[str], budget: int) -> DataFrame:
    """``(lang, note_id, pos, part, chars, total)``: distinct parts without translation in a target language,
    in reading order, while their characters fit the budget. Notes known as a whole need none of theirs.

    Texts stand for themselves by their SHA-256, and languages lie side by side until a part's first
    place is known, so neither texts nor a row for each language are shuffled.
    """
    digest = lambda c: F.unhex(F.sha2(c, 256))
    known = tm.where("norm <> ''").groupBy(digest(F.col("norm")).alias("key")).agg(F.collect_set("lang").alias("known"))
    notes = df.select("note_id", digest(norm_space(F.col("text"))).alias("key")).where("key is not null")
    whole = notes.join(known, "key").groupBy("note_id").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("whole"))
    norm = norm_space(F.col("value"))
    each = parts(df).where("value <> ''").select("note_id", "pos", "part", digest(norm).alias("key"), F.length(norm).cast("long").alias("chars"))
    at, missing = F.struct("note_id", "pos", "part"), lambda lang: ~F.coalesce(F.array_contains("whole", lang), F.lit(False))
    firsts = [F.min(F.when(missing(lang), at)).alias(f"_{i}") for i, lang in enumerate(langs)]
    one = each.join(whole, "note_id", "left").groupBy("key").agg(F.first("chars").alias("chars"), *firsts).join(known, "key", "left")
    found = F.array(*[F.struct(F.lit(lang).alias("lang"), F.col(f"_{i}").alias("at")) for i, lang in enumerate(langs)])
    told = lambda x: x.at.isNotNull() & ~F.coalesce(F.array_contains("known", x.lang), F.lit(False))
    one = one.select("chars", F.explode(F.filter(found, told)).alias("x")).select("x.lang", "x.at.*", "chars")
    return running_totals(one, "note_id", ["pos", "part", "lang"], "chars", budget).select("lang", "note_id", "pos", "part", "chars", "total")


def tm_merge(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The union of two memories ``(lang, norm, translation)``; what is held already stays."""
    return current.unionByName(incoming.dropDuplicates(["lang", "norm"]).join(current, ["lang", "norm"], "left_anti"))
