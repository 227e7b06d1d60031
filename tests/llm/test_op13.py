import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from glidemesh.llm import op13_periodic_runs as op


def smallest_period(x):
    return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))


def brute(x, repeats=4, least=6):
    """Runs by the definition: stretches of equal partners q apart, their smallest period checked."""
    n, out = len(x), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, repeats * q) and smallest_period(x[i : j + q]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(seed=0):
    rng = random.Random(seed)
    out = [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2, 1, 2, 1, 2, 1], [0] * 300, [0, 1] * 200]
    for _ in range(120):
        x = []
        while len(x) < rng.randint(1, 150):
            unit = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randint(1, 12))]
            x += unit * rng.choice((1, 1, 2, 3, 4, 5, 9)) + unit[: rng.randrange(len(unit) + 1)]
        out.append(x)
    return out


@pytest.mark.parametrize("v", [1, 3, 7, 31])
def test_runs_as_the_definition(v):
    seqs = sequences()
    got = op.runs_of([np.array(s, np.int64) for s in seqs], op.RunParams(cover=v))
    want = [brute(s) for s in seqs]
    assert sum(map(len, want)) > 100
    assert [[tuple(r) for r in g.tolist()] for g in got] == want


def test_extensions_and_cover():
    rng = np.random.default_rng(1)
    for v in (1, 2, 7, 31):
        cover = op.difference_cover(v)
        assert len({(a - b) % v for a in cover for b in cover}) == v
        seq = np.concatenate([rng.integers(0, 2, 300), np.tile([0, 1, 1], 60)])
        x, y = np.triu_indices(len(seq), 1)
        pick = rng.integers(0, len(x), 4000)
        x, y = x[pick], y[pick]
        want = [next((d for d in range(len(seq) - b) if seq[a + d] != seq[b + d]), len(seq) - b) for a, b in zip(x, y)]
        assert op.Extensions(seq, v, cover, np.array([0]))(x, y).tolist() == want


def expected(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


COLS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_as_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "  \n", "a", "b\tb\vb b b\nb b", "é x " * 9, "x y " * 3]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(80)]
    texts += [" ".join(map(str, s)) for s in sequences(2)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in op.query(spark, str(tmp_path)).collect()}
    assert got == {i: expected(i, t) for i, t in enumerate(texts)}
    assert sum(v[0] for v in got.values()) > 20


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(sf + "/documents.parquet").collect() if len(r.text or "") < 4_000}
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in op.query(spark, sf).collect()}
    assert len(got) == 200 and all(got[i] == expected(i, t) for i, t in docs.items())


def test_null_ids_repeats_empty_and_long(spark):
    rows = [(None, "a " * 8), (None, None), (4, "b c " * 5), (4, "b c " * 5), (7, "m n o " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in op.find_runs(df).collect())
    assert got == [
        (0, [], b""), (8, [(0, 8, 1)], b"a"), (10, [(0, 10, 2)], b"b c"), (10, [(0, 10, 2)], b"b c"), (120_000, [(0, 120_000, 3)], b"m n o")
    ]
    assert op.find_runs(df.limit(0)).count() == 0
