import random
import zlib

import pytest

from glidemesh.llm import op02_toxicity as op

BAD = ["vileword", "nastything", "rottenfool", "grimclown"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["the", "an", "er", "on", "ti", "sh", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tox")
    docs, labels = corpus(900)
    docs += [(900, None), (901, ""), (None, "no id"), (5, docs[5][1]), (902, "word " * 60_000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels + [(None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    return str(d), {i: t for i, _, t in labels}


def test_held_out_rows_are_told_apart(spark, tables):
    sf, truth = tables
    got = op.query(spark, sf).collect()
    assert len(got) == 905
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    scores = {r.doc_id: r.score for r in got}
    assert scores[900] == scores[901] and len({r.score for r in got if r.doc_id == 5}) == 1


def test_filter_keeps_columns(spark, tables):
    sf, truth = tables
    docs = spark.read.parquet(sf + "/documents.parquet").selectExpr("doc_id", "text", "doc_id as score")
    kept = op.drop_toxic(docs, spark.read.parquet(sf + "/labels.parquet"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert sum(truth.get(i, 0) for i in ids) < 0.1 * sum(truth.values())
    assert sum(1 for i, t in truth.items() if not t and i in ids) > 0.97 * sum(1 for t in truth.values() if not t)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = op.fit(docs, labels)
    assert op.score(docs, model).first().predicted == 0
    assert op.score(docs.limit(0), model).count() == 0


def test_remembered_gains_are_the_gains():
    distance = op.Distance(b"toxic words here " * 20, b"ordinary words there " * 20)
    known = op.Remembered(distance, 3)
    texts = ["toxic words here and there", "ordinary words", None, "", "toxic words here and there", "a b c d a b c d a b c d e"]
    for t in texts * 2:
        ws = op.windows(t, 4)
        assert known.gains(ws).tolist() == distance(ws).tolist()


def test_only_telling_windows_are_compressed(monkeypatch):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = said(1_500).encode()
    own = base[200:260] + b" " + " ".join(BAD).encode() + b" " + base[900:1_000]
    ws = [w for _ in range(300) for w in op.windows(said(8) + rng.choice(["", "", " " + rng.choice(BAD)]), 4)] + op.windows("ab x", 4)

    def brute(w):
        w = w[len(op.ANCHOR) :]
        return any(w[i:j] in own + base and w[i:j] not in base for i in range(len(w)) for j in range(i + 4, len(w) + 1))

    telling, done = op.Telling(own + base, base)(ws).tolist(), []
    # none is passed over; a few more are taken for a long string's first bytes
    assert all(t for w, t in zip(ws, telling) if brute(w))
    assert sum(t and not brute(w) for w, t in zip(ws, telling)) < 0.1 * len(ws) and sum(telling) < 0.6 * len(ws)
    distance = op.Distance(own + base, base)
    whole = distance.ordinary(ws) - distance.toxic(ws)
    toxic = distance.toxic
    monkeypatch.setattr(distance, "toxic", lambda some: done.extend(some) or toxic(some))
    assert distance(ws).tolist() == [g if t else 0 for g, t in zip(whole.tolist(), telling)]
    assert done == [w for w, t in zip(ws, telling) if t] and max(g for g, t in zip(whole, telling) if not t) <= 0
    for toxic_text, ordinary in ((b"", b""), (b"abc", b""), (b"abcde", b"cde"), (base, base), (b"xy" + base, base)):
        d = op.Distance(toxic_text, ordinary)
        assert len(d(ws)) == len(ws) and d([]).tolist() == []
