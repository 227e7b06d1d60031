import html

import pytest
from pyspark.sql import functions as F

from glidemesh.functions import text
from glidemesh.operators import candidates
from glidemesh.plans import candidates as plans
from glidemesh.sources import sites
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, name):
    got = rows_of_spark(plans.QUERIES[name](spark, SF))
    assert got == rows_of_duckdb(plans.ORACLES[name], SF) and got[1]


def test_submissions_that_are_not_finite_and_photos(spark):
    photo = "array<struct<type:string,bytes:long,long_edge:int>>"
    ok = ("image/jpeg", 1000, 4000)
    rows = [
        ("update", "nan", "6", [ok], None), ("update", "1e400", "6", [ok], None), ("new-field", "45", "Infinity", [], "a"), ("update", "45", "6", [ok, ("image/png", 1, 1)], None),
        ("update", "45", "6", [("image/jpeg", 15_728_641, 4000)], None), ("update", "45", "6", [("image/jpeg", 10, 2559)], None), ("new-field", "45", "6", [("image/jpeg", 10, None)], " d "),
    ]
    df = spark.createDataFrame(rows, f"type string, lat string, lon string, photo_files {photo}, difficulty string")
    df = df.select("*", F.lit("abcd").alias("name"), F.lit("fr").alias("country"), F.lit("x").alias("site_id"), F.lit("t").alias("description"), F.size("photo_files").alias("photos"), F.repeat(F.lit("r"), 30).alias("runway"), F.lit("4e2").alias("length_m"), F.lit("NaN").alias("width_m"))
    good, bad = sites.check_submissions(df)
    assert sorted(r.reason for r in bad.collect()) == ["coordinates", "photo-edge", "photo-size", "photo-type", "reference", "reference"]
    (r,) = good.collect()
    assert (r.difficulty, len(r.runway), r.length_m, r.width_m) == ("", 20, 400.0, None)


def test_character_references(spark):
    texts = ["a &amp;lt; b", "&eacute;&#233;&#xE9;&#x1F600; &nbsp;x", "&nosuch; & &; &#0;", "", "Z&uuml;rich &euro;5 &lt;b&gt;", None]
    got = {r.t: r.u for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescape(F.col("t")).alias("u")).collect()}
    assert got == {t: None if t is None else html.unescape(t) for t in texts}


def test_index_and_modes(spark):
    m = spark.createDataFrame([(2, "b", "B", {"en": "B"}, None, 5, 1), (1, "a", "A", None, True, 7, 2)], "pack_rank int, pack_id string, name string, names map<string,string>, hidden boolean, bytes long, sites long")
    assert [(r.id, r.hidden, r.manifest_url, r.size_bytes, r.fields_count) for r in candidates.publish_index(m).collect()] == [("a", True, "packs/a/manifest.json", 7, 2), ("b", False, "packs/b/manifest.json", 5, 1)]
    with pytest.raises(ValueError):
        candidates.pick_candidates(m, m, "some", [])
