import hashlib
import random

import numpy as np
import pytest

from glidemesh.llm import op11_suffix_dedup as op


def brute(docs, length=100):
    """``{id: (bytes, removed, spans, kept)}``, by a dictionary of all strings."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for a in range(len(raw) - length + 1):
            s = raw[a : a + length]
            if s in seen:
                gone[a + 1 : a + 1 + length] = True
            seen.add(s)
        edges = np.flatnonzero(gone[1:] & ~gone[:-1])
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out[i] = (len(raw), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest())
    return out


def results(df):
    return {
        r.doc_id: (r.n_bytes, sum(s.e - s.a for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()
    }


def corpus(seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line, base = prose(40), prose(22), prose(120)
    docs = [None, "", "short", "a" * 99, "a" * 100, "a" * 3000, "ab" * 700, base]
    for _ in range(60):
        kind = rng.randrange(5)
        if kind == 0:
            docs.append(base)
        elif kind == 1:  # near copies
            w = base.split()
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append(" ".join(w))
        elif kind == 2:
            docs.append(prose(rng.randint(0, 60)) + "\n" + line + "\n" + prose(30))
        elif kind == 3:
            docs.append(prose(20) + passage + prose(10) + passage)
        else:
            docs.append(prose(rng.randint(0, 200)))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("p", [op.RepeatParams(), op.RepeatParams(chunk_pieces=3, most_starts=16, batch_bytes=500)])
def test_as_brute_force(spark, p):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 7, 1) for i, t in docs], "doc_id long, text string, h int, spans int").repartition(5)
    want = brute(docs)
    assert sum(w[1] for w in want.values()) > 10_000
    assert results(op.drop_repeats(df, p)) == want


def test_other_lengths(spark):
    docs = corpus(1)[:30]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert results(op.drop_repeats(df, op.RepeatParams(length=41))) == brute(docs, 41)


def test_repeated_rows_ids_and_nulls(spark):
    t = "one passage of more than a hundred bytes " * 3
    rows = [(3, t), (3, t), (5, t + "x"), (None, t), (None, None), (1, "y" + t[:110]), (9, "z" * 50 + t)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.kept).decode()) for r in op.drop_repeats(df).collect())
    want = {i: w for i, w in brute([(1, "y" + t[:110]), (3, t), (5, t + "x"), (9, "z" * 50 + t)]).items()}
    assert len(got) == len(rows) and got[:2] == [(-1, ""), (-1, t)] and got[3] == got[4]
    assert all(hashlib.sha256(k.encode()).hexdigest() == want[i][3] for i, k in got if i > 0)


def test_two_texts_under_one_id_and_empty(spark):
    a, b = "first text " * 20, "xx" + "first text " * 20
    df = spark.createDataFrame([(1, a), (1, b)], "doc_id long, text string")
    assert sum(len(r.kept) for r in op.drop_repeats(df).collect()) < len(a) + len(b) - 100
    assert op.drop_repeats(df.limit(0)).count() == 0


def test_longest_previous_against_definition():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(400 - 12 + 1)
    raw = buf.tobytes()
    ranks = op.suffix_ranks(buf, starts, 12)
    order = sorted(set(raw[i : i + 12] for i in starts))
    assert [order[r] for r in np.unique(ranks, return_inverse=True)[1]] == [raw[i : i + 12] for i in starts]
    want = [raw[i : i + 12] in {raw[j : j + 12] for j in range(i)} for i in starts]
    assert op.longest_previous(ranks).tolist() == want
    pos = rng.permutation(50)
    assert op.smaller_before(pos).tolist() == [max([j for j in range(i) if pos[j] < pos[i]], default=-1) for i in range(50)]


def test_query_on_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.query(spark, sf).collect()}
    assert got == brute(docs)
