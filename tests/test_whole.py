import re

from glidemesh.operators import golden
from glidemesh.plans import whole
from tests.oracle import rows_of_duckdb, rows_of_spark

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    got, want = rows_of_spark(whole.query(spark, SF)), rows_of_duckdb(whole.SQL, SF)
    assert got[0] == want[0] and got[1][:3] == want[1][:3] and got[1] == want[1] and got[1]


def test_frequencies_of_texts_and_empty_groups(spark):
    schema = """gid long, src_seq long, name string, code string, country string, kind string, difficulty string, raw_difficulty string, source string, frequency string,
      lat double, lon double, elev_m double, length_m double, width_m double, heading_deg double, freqs array<struct<mhz:double,type:string,description:string,source:string>>,
      media array<struct<url:string,source:string>>, docs map<string,string>, notes map<string,string>"""
    base = dict(name="Alp", code="LFXX", country="FR", kind="airfield", difficulty="A", raw_difficulty=None, lat=45.0, lon=7.0, elev_m=None, length_m=None, width_m=None, heading_deg=None, docs=None)
    rows = [
        dict(base, gid=1, src_seq=1, source="Guide", frequency="A/A 123,5", freqs=None, media=[("a", "x"), ("b", "x")], notes={"fr": "un"}),
        dict(base, gid=1, src_seq=2, source="OpenAIP", frequency=None, freqs=[(123.5, "INFO", None, "OpenAIP"), (119.7, "AFIS", "", "OpenAIP"), (None, "x", "", "")], media=[("b", "y"), (" ", "y"), ("c", "y")], notes={"fr": "un", "en": "one"}),
        dict(base, gid=2, src_seq=3, source="Guide", frequency="", freqs=[], media=None, notes=None),
    ]
    names = [c.strip().split(" ")[0] for c in schema.replace("\n", " ").replace("<mhz:double,type:string,description:string,source:string>", "").replace("<url:string,source:string>", "").replace("<string,string>", "").split(",")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = {r.gid: r for r in golden.whole_records(df).collect()}
    one, two = got[1], got[2]
    assert [(f.mhz, f.type, f.source) for f in one.frequencies] == [(119.7, "AFIS", "OpenAIP"), (123.5, "INFO", "OpenAIP")] and one.frequency == "119.700 AFIS"
    assert [(m.url, m.source) for m in one.media] == [("a", "x"), ("b", "x"), ("c", "y")] and one.notes == {"fr": "un", "en": "one"}
    assert (two.frequencies, two.frequency, two.media, two.notes) == ([], "", [], None)


def test_golden_records_are_dealt_once(spark):
    """All rules of the golden records stand on one shuffle of the lines, the one by order."""
    plan = whole.QUERIES["A2_A6_golden_records_whole"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert dealt and set(dealt) == {"l_orderkey"}
