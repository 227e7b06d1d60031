import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from glidemesh.functions.text import upper_each
from glidemesh.operators import notes, totals
from glidemesh.plans import notes_all
from tests.oracle import TABLES, rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(notes_all.QUERIES))
def test_query_equals_sql(spark, name):
    got = rows_of_spark(notes_all.QUERIES[name](spark, SF))
    assert got == rows_of_duckdb(notes_all.ORACLES[name], SF) and got[1]


def test_memory_takes_every_conversation(spark):
    talks = spark.createDataFrame([(0, "even"), (1, " odd \nline"), (3, "line")], "conv_id long, text string")
    assert {r.norm for r in notes.memory(talks).collect()} == {"even", "odd", "line"}


def test_labels_whole_notes_and_languages(spark):
    df = spark.createDataFrame([(1, "Surface: grass\n- new  line\n"), (2, "one\ntwo"), (3, None), (4, "12:30 x")], "note_id long, text string")
    held = [("fr", "Surface:", "Sol :"), ("fr", "grass", "herbe"), ("fr", "one two", "un deux"), ("de", "two", "zwei")]
    tm = spark.createDataFrame(held, "lang string, norm string, translation string")
    got = {(r.note_id, r.lang): (r.text, r.whole, r.hits, r.fallbacks) for r in notes.translate_notes(df, tm, ["fr", "de"]).collect()}
    assert got == {
        (1, "fr"): ("Sol : herbe\n- new  line\n", False, 2, 1), (1, "de"): ("Surface: grass\n- new  line\n", False, 0, 3),
        (2, "fr"): ("un deux", True, 1, 0), (2, "de"): ("one\nzwei", False, 1, 1),
        (4, "fr"): ("12:30 x", False, 0, 1), (4, "de"): ("12:30 x", False, 0, 1),
    }
    missed = [(r.lang, r.note_id, r.pos, r.part) for r in notes.lang_misses(df, tm, ["fr", "de"], 31).orderBy("total").collect()]
    assert missed == [("de", 1, 0, 0), ("de", 1, 0, 1), ("de", 1, 1, 0), ("fr", 1, 1, 0)]
    more = spark.createDataFrame([("fr", "grass", "gazon"), ("fr", "new", "nouveau"), ("fr", "new", "nouveau")], tm.schema)
    assert sorted(map(tuple, notes.tm_merge(tm, more).collect())) == sorted([*held, ("fr", "new", "nouveau")])


def test_query_equals_sql_beyond_plain_letters(spark, tmp_path):
    """Sharp s and other letters of several capitals, wide spaces, and line ends that are no newline."""
    texts = ["straße\n- ŉ und ǰ ᾳ ƛ", " Maß : auf\rab\n* wide　", "Weg: a\u2028b\nWeg: c\r\nOrt: \x0bd", "Weg: e\x85", "Maß", "all ß\none"]
    talks = ["straße\nMaß", "ŉ und ǰ ᾳ ƛ\u2003", "auf\rab\nwide", "Weg:\nd", "all ß one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(i, t) for i, t in enumerate(talks)], "conv_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    for t in TABLES:
        src = next(tmp_path.glob({"documents": "d/*.parquet", "conversations": "c/*.parquet"}.get(t, "none")), f"{SF}/{t}.parquet")
        (tmp_path / f"{t}.parquet").symlink_to(src)
    for name in sorted(notes_all.QUERIES):
        got = rows_of_spark(notes_all.QUERIES[name](spark, str(tmp_path)))
        assert got == rows_of_duckdb(notes_all.ORACLES[name], tmp_path) and got[1]


def test_misses_are_met_by_digest(spark):
    """Neither texts nor a row for each language are dealt."""
    plan = notes_all.QUERIES["T3_misses_in_budget_all"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [set(re.findall(r"(\w+)#", x)) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    assert {"key"} in dealt and not any(x & {"lang", "value"} for x in dealt)


def test_upper_each_is_duckdbs_over_all_letters(spark):
    con = duckdb.connect()
    want = dict(con.execute("select c, upper(c) from (select chr(i::int) c from range(1, 1114112) t(i) where i not between 55296 and 57343) x").fetchall())
    got = spark.createDataFrame([(c,) for c in want if ord(c) < 0x20000], "c string").select("c", upper_each(F.col("c")).alias("u"))
    assert [(r.c, r.u, want[r.c]) for r in got.collect() if r.u != want[r.c]] == []
    assert spark.range(1).select(upper_each(F.lit("aßbßßc")).alias("u")).first().u == "AẞBẞẞC"


def test_running_totals_over_all_levels(spark):
    """Keys over the whole 64 bits, null and negative ones, ties and null values, against one pass."""
    rng = random.Random(1)
    keys = [rng.choice([rng.randrange(-(2**63) + 1, 2**63), rng.randrange(-300, 300), rng.randrange(2**20), 7]) for _ in range(600)]
    rows = [(k, i, rng.choice([None, 1, 5, 40])) for i, k in enumerate(keys)] + [(None, i, 3) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, i long, v long").repartition(5)
    want, total = {}, 0
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        total += v or 0
        want[k, i] = total
    got = totals.running_totals(df, "k", ["i"], "v")
    assert {(r.k, r.i): r.total for r in got.collect()} == want
    half = total // 2
    assert {(r.k, r.i): r.total for r in totals.running_totals(df, "k", ["i"], "v", half).collect()} == {k: t for k, t in want.items() if t <= half}
    assert totals.running_totals(df.limit(0), "k", ["i"], "v").count() == 0


def test_no_text_is_shuffled_for_each_language(spark):
    """Before, notes were dealt three times over by their whole texts, and each part six times for every language."""
    df = spark.createDataFrame([(1, "a\nb: c"), (1, "a\nz"), (2, "whole"), (None, "whole"), (3, None), (4, "")], "note_id long, text string")
    tm = spark.createDataFrame([("en", "a", "A"), ("fr", "whole", "TOUT"), ("de", "c", "C"), ("de", "c", "K"), ("it", "a", "I"), ("en", "b:", None)], "lang string, norm string, translation string")
    got = notes.translate_notes(df, tm, ["en", "fr", "de"])
    rows = {(r.note_id, r.lang, r.text, r.whole, r.hits, r.fallbacks) for r in got.where("note_id is null or note_id <> 1").collect()}
    assert rows == {
        (2, "fr", "TOUT", True, 1, 0), (2, "en", "whole", False, 0, 1), (2, "de", "whole", False, 0, 1),
        (None, "fr", "TOUT", True, 1, 0), (None, "fr", "TOUT", False, 1, 0), (None, "en", "whole", False, 0, 1), (None, "de", "whole", False, 0, 1),
        (4, "en", "", False, 0, 0), (4, "fr", "", False, 0, 0), (4, "de", "", False, 0, 0),
    }
    one = {r.lang: (r.hits, r.fallbacks) for r in got.where("note_id = 1").collect()}
    assert one == {"en": (2, 3), "fr": (0, 5), "de": (2, 4)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(langs") < plan.index("RepartitionByExpression")
