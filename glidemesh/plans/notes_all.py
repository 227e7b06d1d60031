"""Notes against the memory of all conversations, in every target language, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from glidemesh.functions.text import upper_each
from glidemesh.operators import notes
from glidemesh.sources.fixtures import derive, plain

LANGS, BUDGET = ["en", "fr", "de"], 300_000
CONVERSATIONS = "SELECT text FROM {conversations}"


def memory(s, d):
    """Every line of every conversation, in each language; a line is German only if it has an even number of characters."""
    lines = notes.memory(derive(s, d, CONVERSATIONS)).withColumn("norm", notes.norm_space(F.col("norm"))).select("norm").distinct()
    each = lines.withColumn("lang", F.explode(F.array(*map(F.lit, LANGS)))).where("lang <> 'de' or length(norm) % 2 = 0")
    return each.select("lang", "norm", F.concat("lang", F.lit(" "), upper_each(F.col("norm"))).alias("translation"))


QUERIES = {
    "T1_segment_notes_all": lambda s, d: notes.parts(derive(s, d, notes.NOTES)).withColumn("value", F.md5("value")),
    "T2_T5_memory_lookup_all": lambda s, d: notes.translate_notes(derive(s, d, notes.NOTES), memory(s, d), LANGS).withColumn("text", F.md5("text")),
    "T3_misses_in_budget_all": lambda s, d: notes.lang_misses(derive(s, d, notes.NOTES), memory(s, d), LANGS, BUDGET),
}

SPACE = r"trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g'))"
LABEL = notes.LABEL
HEAD = f"""WITH s AS ({notes.SEGMENTS_SQL.format(notes=plain(notes.NOTES))}), langs AS (SELECT unnest({LANGS}) AS lang),
m AS (SELECT DISTINCT lang, norm, lang || ' ' || upper(norm) AS translation FROM (SELECT {SPACE.format('line')} AS norm FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) x) y, langs
  WHERE norm <> '' AND (lang <> 'de' OR length(norm) % 2 = 0)),
w AS (SELECT doc_id AS note_id, lang, translation FROM documents, langs JOIN m USING (lang) WHERE m.norm = {SPACE.format('text')}),
l AS (SELECT note_id, pos, mark, CASE WHEN regexp_matches(value, '{LABEL}') THEN [regexp_extract(value, '{LABEL}', 1) || ':', regexp_extract(value, '{LABEL}', 2)] ELSE [value] END AS v FROM s),
p AS (SELECT note_id, pos, mark, unnest(range(len(v))) AS part, unnest(v) AS value FROM l),
e AS (SELECT p.*, lang, {SPACE.format('value')} AS norm FROM p, langs WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.note_id = p.note_id AND w.lang = langs.lang)),
h AS (SELECT e.*, translation FROM e LEFT JOIN m ON m.lang = e.lang AND m.norm = e.norm)"""
ORACLES = {
    "T1_segment_notes_all": f"""WITH s AS ({notes.SEGMENTS_SQL.format(notes=plain(notes.NOTES))}),
    l AS (SELECT note_id, pos, mark, CASE WHEN regexp_matches(value, '{LABEL}') THEN [regexp_extract(value, '{LABEL}', 1) || ':', regexp_extract(value, '{LABEL}', 2)] ELSE [value] END AS v FROM s)
    SELECT note_id, pos, mark, part, md5(value) AS value FROM (SELECT note_id, pos, mark, cast(unnest(range(len(v))) as integer) AS part, unnest(v) AS value FROM l) p""",
    "T2_T5_memory_lookup_all": f"""{HEAD}, t AS (SELECT note_id, lang, pos, mark[1:] || string_agg(coalesce(translation, value), ' ' ORDER BY part) AS line, count(translation) AS hits, count(*) FILTER (translation IS NULL AND value <> '') AS fallbacks FROM h GROUP BY note_id, lang, pos, mark)
    SELECT note_id, lang, md5(translation) AS text, true AS whole, 1 AS hits, 0 AS fallbacks FROM w
    UNION ALL SELECT note_id, lang, md5(string_agg(line, chr(10) ORDER BY pos)), false, cast(sum(hits) as bigint), cast(sum(fallbacks) as bigint) FROM t GROUP BY note_id, lang""",
    "T3_misses_in_budget_all": f"""{HEAD}, f AS (SELECT lang, norm, min((note_id, pos, part)) AS first FROM h WHERE translation IS NULL AND value <> '' GROUP BY lang, norm),
    g AS (SELECT lang, first, length(norm) AS chars, sum(length(norm)) OVER (ORDER BY first, lang) AS total FROM f)
    SELECT lang, first[1] AS note_id, first[2] AS pos, first[3] AS part, chars, cast(total as bigint) AS total FROM g WHERE total <= {BUDGET}""",
}
