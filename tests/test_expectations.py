import os.path

import pytest
from pyspark.sql import functions as F

from glidemesh.operators import expectations, packs
from glidemesh.plans import expectations as plans
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, name):
    got = rows_of_spark(plans.QUERIES[name](spark, SF))
    assert got == rows_of_duckdb(plans.ORACLES[name], SF) and got[1]


def test_every_rule_is_broken_somewhere(spark):
    assert {r.rule for r in plans.QUERIES["D1_check_packs"](spark, SF).select("rule").distinct().collect()} == set(expectations.RULES)


def test_ways_out_of_the_folder(spark):
    urls = ["a.jpg", "./a//b/../c", "../q/a", "../../p/a", "/p/a", "a/../../../b", "..", "a/.."]
    df = spark.createDataFrame([("p", u) for u in urls], "pack string, url string")
    got = {r.url: r.way for r in df.select("url", expectations.resolved(F.col("pack"), F.col("url")).alias("way")).collect()}
    assert got == {"a.jpg": "p/a.jpg", "./a//b/../c": "p/a/c", "../q/a": "q/a", "../../p/a": None, "/p/a": None, "a/../../../b": None, "..": "", "a/..": "p"}
    for u, way in got.items():
        whole = os.path.normpath(os.path.join("/root/p", u))
        assert way is None or os.path.normpath(f"/root/{way}") == whole


def test_sound_packs_and_empty_tables(spark):
    pack = ("p", "p", "1", None, True, True, "1", True)
    p = spark.createDataFrame([pack], "pack string, manifest_id string, version string, fields_url string, has_media_manifest boolean, media_manifest_ok boolean, media_version string, has_state boolean")
    s = spark.createDataFrame([("p", 0, "a", "A", 45.0, 7.0, {"en": "", "fr": "", "de": "x"}, [("m.jpg", "image")]), ("p", 1, "b", "B", 45.0, 7.0, None, None)], "pack string, pos long, site_id string, name string, lat double, lon double, notes map<string,string>, media array<struct<url:string,type:string>>")
    f = spark.createDataFrame([("p/m.jpg",), ("p/m.jpg",)], "path string")
    breaches, counts = expectations.check_packs(p, s, f)
    assert breaches.collect() == [] and [tuple(r) for r in counts.collect()] == [("p", 2, 1, 1, 0, 0)]
    breaches, counts = expectations.check_packs(p, s.limit(0), f)
    assert [r.rule for r in breaches.collect()] == ["fields-empty"] and counts.first().sites == 0


def test_documents_in_natural_order(spark):
    rows = [(1, "X", "ADC", "1", "en"), (2, "X", "VAC", "10", "es"), (3, "X", "VAC", "2", "es"), (4, "X", "vac", "2", "EN"), (5, "X", "VAC", "2-10", "en"), (6, "X", "VAC", "2-9", "en"), (7, "X", "VAC", "a", "es"), (8, "X", "SID", "1", "en")]
    df = spark.createDataFrame(rows, "seq long, code string, type string, suffix string, lang string")
    assert [tuple(r) for r in packs.ordered_documents(df, "en", ["VAC", "ADC"]).collect()] == [("X", [7, 4, 6, 5, 2, 1])]
