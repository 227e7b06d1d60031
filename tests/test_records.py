"""Cases of the record functions that the derived tables do not hold."""

from pyspark.sql import functions as F

from glidemesh.functions import geo, records


def one(spark, col, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(col.alias("x")).first().x


def test_distance_of_null_is_null(spark):
    assert one(spark, geo.haversine_m(F.col("a"), F.lit(7.0), F.lit(45.0), F.lit(7.0)), a=None) is None


def test_empty_and_broken_records(spark):
    for raw in (None, "", "{", "[]", '{"lat":""}'):
        assert one(spark, records.extract_point(F.col("a")), a=raw) is None
        assert one(spark, records.is_relevant(F.col("a"), [1]), a=raw) is False
        assert one(spark, records.note_value(F.col("a"), ["Surface"]), a=raw) == ""
    assert one(spark, records.normalize_metres(F.col("a")), a='{"value":0,"unit":"ft"}') is None


def test_cycle_dates(spark):
    for raw, want in (("260709", "2026-07-09"), ("x/2026JUN25/y", "2026-06-25"), ("09-JUL-26 (AIRAC)", "2026-07-09"), ("09-XYZ-26", None)):
        got = one(spark, records.parse_cycle_date(F.col("a")), a=raw)
        assert (str(got) if got else None) == want
