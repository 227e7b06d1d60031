import pytest

from glidemesh.llm import op03_compaction as op


def store(spark, tmp_path, **kw):
    return op.ShardStore(spark, f"file://{tmp_path}/s", op.ShardParams(target_bytes=20_000, least_bytes=500, **kw))


def rows(spark, lo, hi):
    return spark.range(lo, hi, 1, 3).selectExpr("id as doc_id", "repeat(cast(sha2(cast(id as string), 256) as string), 3) as text", "id as _n")


def test_merges_small_runs_and_keeps_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    for i in range(6):
        s.append(rows(spark, i * 20, i * 20 + 20))
    assert s.version() == 6
    n = s.manifest().count()
    last = s.settle()
    assert last > 6 and s.manifest().count() < n
    got = s.read().select("doc_id", "text", "_n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, 0, 120).collect()))
    assert s.manifest(6).count() == n and s.read(6).count() == 120
    assert s.plan(s.manifest()).count() == 0
    assert s.manifest().agg({"n_rows": "sum"}).first()[0] == 120
    s.vacuum()
    assert s.read().count() == 120


def test_commits_are_exclusive_and_versions_stay(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(rows(spark, 0, 5))
    with pytest.raises(op.ConcurrentCommit):
        s.commit(s.manifest(), 0)
    assert s.version() == 1 and s.read().count() == 5


def test_empty_and_query(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.append(rows(spark, 0, 0)) == 0 and s.version() == 0
    df = spark.createDataFrame([(1, "a"), (None, None), (1, "a"), (3, "")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 3]


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert op.query(spark, str(tmp_path)).count() == 0


def test_dealt_arrivals_beside_merged_shards(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(rows(spark, 0, 90).withColumn("part", __import__("pyspark").sql.functions.expr("doc_id % 4")), by="part")
    s.settle()
    s.append(rows(spark, 90, 100).withColumn("part", __import__("pyspark").sql.functions.expr("doc_id % 2")), by="part")
    assert {r.origin for r in s.manifest().collect()} == {"arrival", "merged"}
    got = s.read().select("doc_id", "text", "_n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows(spark, 0, 100).collect()))


def test_no_column_name_clashes(spark, tmp_path):
    s = store(spark, tmp_path)
    names = ["_grp", "_path", "_shard", "arrival", "_by", "tier"]
    df = spark.range(0, 60, 1, 3).selectExpr("id as doc_id", *[f"id % 7 as {n}" for n in names], "repeat('t', 200) as text")
    s.append(df, by="doc_id % 6")
    s.settle()
    assert s.read().columns == df.columns
    assert sorted(map(tuple, s.read().collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        s.read(shard_col="tier")
    df.select("doc_id", "text", "arrival").write.parquet(str(tmp_path / "documents.parquet"))
    assert op.query(spark, str(tmp_path)).count() == 60


def test_every_group_is_one_file_and_settling_ends(spark, tmp_path):
    s = store(spark, tmp_path)
    for i in range(4):
        s.append(rows(spark, i * 64, i * 64 + 64).withColumn("part", __import__("pyspark").sql.functions.expr("doc_id")), by="doc_id % 16")
    plan = s.plan(s.manifest())
    groups, before = plan.select("grp").distinct().count(), s.manifest().count()
    merged = plan.count()
    assert s.compact() and s.manifest().count() == before - merged + groups
    s.settle()
    assert s.plan(s.manifest()).count() == 0 and s.read().count() == 256
