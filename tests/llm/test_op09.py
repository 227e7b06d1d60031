import random
import re

import numpy as np
import pytest

from glidemesh.llm import op09_near_dup as op


def brute(rows, k, percent):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, sh(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets))


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "Ünder", "A b"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, base = [], [text(rng.randint(40, 200)) for _ in range(12)]
    for b in base:
        for _ in range(rng.randint(1, 14)):
            t = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t).upper() if rng.random() < 0.2 else "\t".join(t))
    drift = text(120)  # a chain whose ends are far apart
    for i in range(12):
        drift[i * 9] = f"new{i}"
        rows.append(" ".join(drift))
    rows += [None, "", " \n", "two words", "Two Words", "one", "two  words more", "x " * 50, "x " * 70]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_same_components_as_all_pairs(spark, k, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int")
    got = op.near_duplicates(df, op.NearDupParams(words=k, percent=percent)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_registers_merge_and_estimate():
    p = op.NearDupParams()
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    y = np.concatenate([x[:700], rng.integers(0, 2**63, 150).astype(np.uint64)])
    a, b = op.sketch(x, p), op.sketch(np.unique(y), p)
    assert (op.merge(a, b) == op.sketch(np.union1d(x, y), p)).mean() > 0.99
    est = op.joint_jaccard(a[None], b[None], np.array([len(x)]), np.array([len(y)]), p.base)[0]
    true = 700 / (len(x) + 150)
    assert abs(est - true) < 0.15
    assert (op.sketch(x[:1], p) == op.sketch(x[:1], p)).all()


def test_keep_one_and_edges(spark):
    rows = [(5, "a b c d e f", "s"), (2, "A B C D E F", "t"), (None, "a b c d e f", "u"), (7, None, None), (8, "", "v"), (2, "A B C D E F", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "", r.source or "") for r in got.collect()) == [(0, "a b c d e f", "u"), (2, "A B C D E F", "t"), (7, "", ""), (8, "", "v")]
    assert op.near_duplicates(df.limit(0)).count() == 0


def test_different_texts_under_one_id(spark):
    texts = ["one two three four five six", "red green blue white black grey", "sun moon star sky cloud rain"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[2]), (5, texts[2].upper()), (6, texts[1]), (7, None), (7, "")]
    got = op.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in got) == sorted([(1, texts[0]), (5, texts[1]), (5, texts[2]), (7, ""), (7, "")])
