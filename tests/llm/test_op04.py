import duckdb
import pytest

from glidemesh.llm import op04_mixing as op


def edf(parts):
    n, names = sum(parts.values()), sorted(parts)
    done, run = dict.fromkeys(names, 0), []
    for t in range(n):
        ready = [(-(-(done[s] + 1) * n // parts[s]), s) for s in names if done[s] < parts[s] and done[s] * n // parts[s] <= t]
        s = min(ready)[1]
        done[s] += 1
        run.append(s)
    return run


@pytest.mark.parametrize("parts", [{"a": 1}, {"a": 3, "b": 7}, {"a": 50, **{f"x{i}": 5 for i in range(10)}}, {"a": 34, "b": 33, "c": 33}])
def test_schedule_is_edf_within_one_block(spark, parts):
    got = op.schedule(spark.createDataFrame(list(parts.items()), "source string, parts long")).orderBy("slot").collect()
    run = [r.source for r in got]
    assert run == edf(parts)
    n, done = sum(parts.values()), dict.fromkeys(parts, 0)
    for t, s in enumerate(run, 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / n) < 1 for x, w in parts.items())


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = op.query(spark, sf).toPandas()
    want = duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'") or duckdb.sql(op.SQL).df()
    key = ["doc_id"]
    a, b = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)[got.columns]
    assert (a == b).all().all() and len(a) == 200


def test_edges(spark):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (None, None, None), (2, "", None), (3, "z" * 300_000, "x"), (4, "q", "y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, slot int")
    got = op.mix(df).collect()
    assert len(got) == 6 and {r.source for r in got} == {"x", "y", None}
    back = op.mixed_order(df)
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    given = spark.createDataFrame([("x", 1), ("y", 1), (None, 2)], "source string, parts int")
    assert op.mix(df, given).count() == 6
    assert op.mix(df.limit(0)).count() == 0


def test_more_sources_than_slots_lose_no_row(spark):
    rows = [(i, f"s{i}", 1_000_000) for i in range(1, 1_200)] + [(10_000 + i, "hot", 100_000_000) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = op.mix(df, size=df.n).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted((i, s) for i, s, _ in rows)
    assert all(r.release <= r.slot < r.due for r in got)
    parts = op.default_weights(df.groupBy("source").agg({"n": "sum"}).toDF("source", "bytes"), 1_000).collect()
    assert sum(r.parts for r in parts) == 3_000 and max(parts, key=lambda r: r.parts).source == "hot"


def test_sources_without_a_weight_get_one_part(spark):
    rows = [(i, f"s{i % 30}", "x" * 100) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    given = spark.createDataFrame([("s0", 20), ("s1", 0), ("gone", 4)], "source string, parts int")
    got = op.mix(df, given).collect()
    assert sorted(r.doc_id for r in got) == list(range(600)) and all(r.release <= r.slot < r.due for r in got)
