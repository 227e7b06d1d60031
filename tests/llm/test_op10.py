import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from glidemesh.llm import op10_token_counts as op

PATH = P.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def awkward(seed, n):
    rng = random.Random(seed)
    bits = ["Word", " and", "  ", "\n", "\x1c", "\x85", "\xa0", "'s", "é", " ́x", "İ", "日本語", "123", "!!", " x", "<|endoftext|>", " <|startoftext|> ", "ﬁ", "Σς "]
    return "".join(rng.choice(bits) for _ in range(n))


def count(t):
    return len(TOK.encode(t or "", add_special_tokens=False))


@pytest.mark.parametrize("chunk,overlaps", [(64, (8, 24)), (1 << 16, (512,))])
def test_same_counts_as_library(spark, chunk, overlaps):
    texts = [None, "", "  ", "a", *[awkward(i, 60 * i) for i in range(1, 9)], "x" * 500, "no white" * 60, "a b " * 300]
    df = spark.createDataFrame([(i % 12, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = op.count_tokens(df, PATH, chunk_chars=chunk, overlaps=overlaps, margin=4 if chunk == 64 else 64).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted(
        (i % 12, len((t or "").encode()), count(t)) for i, t in enumerate(texts)
    )


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "a " * 2048), (2, "a " * 2049), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in op.query(spark, str(tmp_path)).collect()}
    assert got == {1: (2048, False), 2: (2049, True), 3: (0, False)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.count_tokens(empty, PATH).count() == 0


def test_special_strings_in_capitals(spark):
    texts = ["<|ENDOFTEXT|>foo", "<|endoftext|>foo", "<|StartOfText|>x.", "a<|ENDOFTEXT|>b <|ENDOFTEXT|> foo", "<|ENDOFTEXT|>foo " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in op.count_tokens(df, PATH).collect()}
    assert got == {i: count(t) for i, t in enumerate(texts)}


def test_very_long_text_at_the_default_chunk_size(spark):
    long = "Wörter and  numbers 123, again!\n" * 6_000
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    assert len(long) > op.CHUNK_CHARS and op.count_tokens(df, PATH).first().n_tokens == count(long)
