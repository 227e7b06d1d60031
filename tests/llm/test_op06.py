import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glidemesh.llm import op06_packing as op
from glidemesh.llm.op01_bpe import encoding
from tests.llm.test_op01 import awkward

PATH = P.path("byte_bpe_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_equals_search_of_all_rows(sizes):
    free, rows = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [f for f in free if f >= sizes[i]]
        if fits:
            free[free.index(min(fits))] -= sizes[i]
        else:
            free.append(32 - sizes[i])
    got = op.best_fit(sizes, 32)
    assert sorted(i for r in got for i in r) == list(range(len(sizes)))
    assert sorted(32 - sum(sizes[i] for i in r) for r in got) == sorted(free)


@pytest.mark.parametrize("seed", range(6))
def test_word_by_word_ids(seed):
    words, enc = op.TokenBytes(PATH, P.PATTERN, 50), encoding(PATH, P.PATTERN)
    for t in [awkward(seed, 80), " a b\nc", "a b ", " ", "it's a\tb's \x85 c", "x " * 100]:
        assert words.of(t).tolist() == enc.encode_ordinary(t)


def test_lossless(spark, tmp_path):
    texts = [awkward(i, 20 + 40 * i) for i in range(12)] + [None, "", "word " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "y")], "doc_id long, text string, ids string")
    p = op.PackParams(length=64, buffer_tokens=900)
    out = op.pack(df, PATH, P.PATTERN, p).collect()
    enc, parts = encoding(PATH, P.PATTERN), {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and (ids[r.n_tokens :] == p.pad_id).all() and r.cu_seqlens[-1] == r.n_tokens and r.resets == r.cu_seqlens[:-1]
        assert [i for i, v in enumerate(op.positions(r.cu_seqlens)) if v == 0] == r.resets
        for d, n, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            parts.setdefault(d, []).append((n, ids[a:b].tolist()))
    assert len({r.pack_id for r in out}) == len(out)
    for i, t in [*enumerate(texts), (None, "no id")]:
        assert [x for _, ids in sorted(parts.get(i, [])) for x in ids] == enc.encode_ordinary(t or "")
    df.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    assert op.query(spark, str(tmp_path)).count() >= 1
    assert op.pack(df.limit(0), PATH, P.PATTERN).count() == 0
