import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.test_op02 import BAD, corpus


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pipe")
    docs, labels = corpus(400, seed=8)
    toxic = {i for i, _, t in labels if t}
    rng = random.Random(2)
    boiler = "this notice stands at the foot of every page of the site"
    rows = [(i, f"{t}\n{boiler}", "en", f"s{i % 3}", len(t)) for i, t in docs]
    words = "one two three four five six seven eight nine ten eleven twelve thirteen".split()
    near = [rng.choice(words) + str(rng.randint(0, 99)) for _ in range(150)]
    for k in range(5):
        rows.append((1000 + k, " ".join(near[:-1] + [["alpha", "bravissimo", "charlemagne", "delta", "echo"][k] * 2]), "en", "s1", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), toxic


def test_stages_take_effect(spark, sf):
    path, toxic = sf
    docs = spark.read.parquet(path + "/documents.parquet")
    cols, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == cols, name
        seen.append(docs.count())
    assert seen[0] > seen[1] >= seen[2] > seen[3] == seen[4]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sum("this notice" in t for t in texts.values()) == 1
    assert sum(i >= 1000 for i in texts) == 1 and 1000 in texts
    assert len({i for i in range(400) if i not in toxic} & set(texts)) >= 0.97 * (400 - len(toxic))
    assert len(toxic & set(texts)) < 0.2 * len(toxic) and BAD
    out = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, path).collect()}
    assert out == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_awkward_rows_and_order(spark, tmp_path):
    line = "a line of a good many words that stands in two documents"
    rows = [(1, f"{line}\nmine alone", "s1"), (2, f"{line}\nyours and no one else's", "s2"), (3, None, "s1"), (4, "", None), (5, "5", "s2"), (5, "5", "s2"), (None, "no id", "s1"), (6, "word " * 30_000, "s1")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n_chars int, _row string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4, 5, 6]
    assert len({(r.slot, r.start) for r in got if r.n_tokens}) == sum(1 for r in got if r.n_tokens)
    again = spark.createDataFrame([(1, "t", "s")], "doc_id long, text string, source string").limit(0)
    again.write.parquet(str(tmp_path / "e" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "e" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_last_stage_plans_the_mix_once(spark):
    from glidemesh.llm import op04_mixing

    rows = [(i, f"text {i} " * (i % 9), f"s{i % 3}") for i in range(60)] + [(7, "another", None), (None, None, "s1"), (99, "word " * 30_000, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.encode(spark, docs, "")
    got = sorted((r.doc_id or -1, r.slot, r.start) for r in out.collect())
    assert got == sorted((r.doc_id or -1, r.slot, r.start) for r in op04_mixing.mix(docs).collect())
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(out) <= windows(op04_mixing.mix(docs))
