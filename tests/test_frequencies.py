"""Labels are looked for around frequencies alone, not around every character."""

import time

from pyspark.sql import functions as F

from glidemesh.functions import text


def test_long_notes_with_few_frequencies(spark):
    """Before, every character was looked at from 25 places before it."""
    note = F.concat(F.repeat(F.lit("no number 118 here "), 5_000), F.lit("TWR 118.250"), F.repeat(F.lit(" more 1.5"), 2_000))
    rows = spark.range(40).repartition(1).select(text.labelled_frequencies(F.concat(note, F.lit(" "), F.col("id"))).alias("f"))
    start = time.perf_counter()
    got = rows.collect()
    assert time.perf_counter() - start < 10
    assert [[tuple(x) for x in r.f] for r in got] == [[(118.25, "TWR")]] * 40
