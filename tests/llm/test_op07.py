import numpy as np
import pytest

from glidemesh.llm import op07_hnsw as op


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_on_given_vectors(spark):
    sf = "/root/testdata/sf0.1"
    pdf = spark.read.parquet(sf + "/embeddings.parquet").toPandas()
    x = np.stack(pdf.embedding).astype(np.float64)
    want = brute(pdf.vec_id.to_numpy(), x)
    got = {}
    for r in op.query(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.97
    assert set(got) == set(want) and all([r for r, _, _ in sorted(g)] == list(range(1, 21)) for g in got.values())


def test_shards_recall_norms_and_copies(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[::3] = x[0]  # a third are copies
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score int")
    p = op.HnswParams(shard_rows=200)
    shards, members = op.index(df, str(tmp_path), p)
    assert shards.count() > 3 and members.count() == 1500
    got = {}
    for r in op.nearest(df.where("vec_id % 20 = 0"), shards, members, p).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = brute(ids, x)
    hits = sum(len({v for _, v in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert hits / (20 * len(want)) >= 0.95
    assert [v for _, v in sorted(got[0])] == [v for v, _ in want[0]]


def test_unusable_and_few(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shards, members = op.index(df, str(tmp_path))
    got = [tuple(r) for r in op.nearest(df.where("vec_id % 20 = 0"), shards, members).collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    none = op.index(df.limit(0), str(tmp_path / "none"))
    assert op.nearest(df.limit(0), *none).count() == 0
