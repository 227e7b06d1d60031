import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from glidemesh.llm import op01_bpe as op

PATH = P.path("byte_bpe_50k.tiktoken")


def awkward(seed, n):
    rng = random.Random(seed)
    bits = ["word", " and", "  ", "\n", "\n\n ", "'s", "don't", "é", "日本語", "12345", "!!!", "\t", " x", "a" * 40, "<|endoftext|>", " "]
    return "".join(rng.choice(bits) for _ in range(n))


def expected(texts):
    enc = op.encoding(PATH, P.PATTERN)
    return [np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("chunk,overlaps", [(64, (8, 24)), (1 << 16, (256,))])
def test_same_ids_as_whole_text(spark, chunk, overlaps):
    texts = [None, "", " ", "   \n", "one", awkward(1, 30), awkward(2, 400), awkward(3, 900), "b" * 700, " " * 500, "a b " * 200, awkward(2, 400)]
    rows = [(None if i == 4 else i, t, i, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long, uid string")
    got = op.decode(op.encode(df, PATH, P.PATTERN, chunk_chars=chunk, overlaps=overlaps), PATH, P.PATTERN).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts)
    for i, (t, ids) in enumerate(zip(texts, expected(texts))):
        r = by[None if i == 4 else i]
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4
        assert bytes(r.decoded).decode() == (t or "")


def test_bounds_are_bounds_of_the_whole_text():
    text = awkward(5, 600)
    whole = set(op.pre_token_bounds(text, P.PATTERN))
    enc = op.encoding(PATH, P.PATTERN)
    for p in list(whole)[::7]:
        assert enc.encode_ordinary(text[:p]) + enc.encode_ordinary(text[p:]) == enc.encode_ordinary(text)


def test_empty_table_and_query_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = op.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_digests(spark, tmp_path):
    spark.createDataFrame([(1, "Hello 日本"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256("Hello 日本".encode()).hexdigest()
    assert got[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[2].n_tokens == 0


def test_very_long_text_at_the_default_chunk_size_keeps_its_place(spark):
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    long = "Wörter and  numbers 123, again!\n" * 6_000
    df = spark.createDataFrame([(1, long, 7), (1, "short", 8), (None, None, 9)], "doc_id long, text string, slot int")
    got = {r.slot: r for r in op.encode(df, path, pattern, keep={"slot": "int"}).collect()}
    enc = op.encoding(path, pattern)
    assert len(long) > op.CHUNK_CHARS and bytes(got[7].ids) == __import__("numpy").array(enc.encode_ordinary(long), dtype="<u4").tobytes()
    assert got[8].n_tokens == len(enc.encode_ordinary("short")) and got[9].n_tokens == 0


def test_decoded_beside_the_ids_from_one_worker(spark, tmp_path):
    texts = [None, "", " ", awkward(2, 400), awkward(3, 900), "b" * 700, "Hello 日本", awkward(2, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op.encode(df, PATH, P.PATTERN, chunk_chars=64, overlaps=(8, 24), decoded=True).collect()}
    assert [bytes(got[i].ids) for i in range(len(texts))] == expected(texts)
    assert [bytes(got[i].decoded).decode() for i in range(len(texts))] == [t or "" for t in texts]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    plan = op.query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
