import math
import random
import re

import numpy as np
import pytest

from glidemesh.llm import op12_lexical_search as op
from tests.oracle import rows_of_duckdb, rows_of_spark

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return [w.translate(LOWER) for w in TERM.findall(t or "")]


def brute(docs, items, top=50):
    tf = [(i, words(t)) for i, t in docs]
    tf = [(i, w, {x: w.count(x) for x in set(w)}) for i, w in tf if w]
    n_docs, n_terms = len(tf), sum(len(w) for _, w, _ in tf)
    out = []
    for item, text in items:
        terms = {}
        for t in set(words(text)):
            df = sum(t in c for _, _, c in tf)
            if df:
                terms[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        scored = []
        for i, w, c in tf:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
            scored.append((-sum(g * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t, g in terms.items() if t in c), i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:top], 1)]
    return sorted(out)


def texts(seed, n, longest):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("Ab", "é", "x9", "İ", "ß", "Zz") for b in range(12)]
    return [rng.choice((" ", ", ", "-", "\n")).join(rng.choice(vocab[: rng.choice((6, 30, 72))]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("p", [op.SearchParams(), op.SearchParams(top=7, shard_docs=40, leaf_docs=3, item_batch=4, block_bytes=200)])
def test_as_brute_force(spark, p):
    docs = list(enumerate([None, "", "-- !", *texts(0, 200, 60)] + ["Ab1 Ab2 é3"] * 60))
    items = list(enumerate([None, "", "absent", *texts(1, 20, 15)]))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = sorted(tuple(r) for r in op.search(d, q, p).collect())
    assert got == brute(docs, items, p.top)


def test_query_and_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of_spark(op.query(spark, sf)) == rows_of_duckdb(op.SQL, sf)


def test_nulls_repeats_and_empty(spark):
    d = spark.createDataFrame([(None, "cat"), (5, "cat dog"), (5, "cat dog"), (7, None), (3, "cat dog"), (9, "eel")], "doc_id long, text string")
    q = spark.createDataFrame([(None, "cat"), (1, "cat"), (1, "dog"), (2, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in op.search(d, q).collect())
    assert [x[:3] for x in got] == [(1, 1, 3), (1, 2, 5), (1, 3, 5)] and len({x[3] for x in got}) == 1
    assert op.search(d.limit(0), q).count() == 0 and op.search(d, q.limit(0)).count() == 0


def test_bounds_hold_and_close_balls():
    rng = np.random.default_rng(0)
    groups = rng.integers(0, 8, 600)
    dense = np.zeros((600, 80), np.int64)
    for i, g in enumerate(groups):
        dense[i, g * 10 + rng.integers(0, 10, 6)] = rng.integers(1, 1_000_000, 6)
    dense[300:] = dense[rng.integers(0, 6, 300)]  # copies
    r, c = np.nonzero(dense)
    x = op.Rows(c, dense[r, c], np.concatenate([[0], np.cumsum(np.bincount(r, minlength=600))]))
    tree = op.BallTree(x, 80, 8)
    q = np.zeros((12, 80), np.int64)
    for k in range(12):
        q[k, rng.integers(0, 80, 7)] = rng.integers(1, 17_000, 7)
    bound, product = tree.bounds(q), dense @ q.T
    for node, (lo, hi) in enumerate(tree.leaf):
        if tree.children[node] is None:
            assert (product[tree.order[lo:hi]] <= bound[node]).all()
    assert (product.max(axis=0) <= bound[0]).all()
    for k in range(12):
        ids, score = tree.search(q[k], bound[:, k], np.arange(600), 5)
        want = [i for i in np.lexsort((np.arange(600), -product[:, k])) if product[i, k] > 0][:5]
        assert ids.tolist() == want and score.tolist() == product[want, k].tolist()
    big = np.array([0, 1, 2, 4, 10**16, 10**16 + 1, (3 * 10**8) ** 2 - 1])
    assert [int(v) for v in op._ceil_root(big)] == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in big]
