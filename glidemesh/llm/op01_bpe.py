"""Byte-level BPE encoding and decoding by overlapping chunks."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glidemesh.llm.common import table
from glidemesh.llm.overlap import owned_parts

CHUNK_CHARS = 1 << 16
OVERLAPS = (256, 16_384)
#: Rows that a task hands on at once, so that ids and decoded bytes of few texts are held together.
HANDED_ROWS = 500
#: Characters at a cut end whose reading may change: the longest fixed alternative of the pattern.
MARGIN = 4


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, built once in each Python worker."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    return regex.compile(pattern)


def pre_token_bounds(text: str, pattern: str) -> list[int]:
    """Starts of pre-tokens that follow a character which is not white space.

    The pattern looks only ahead, so what follows such a start is read the same from anywhere; and
    as the pre-token before it does not end in white space, it reads the same when the text is cut
    here.
    """
    return [p for m in _pattern(pattern).finditer(text) if (p := m.start()) and not text[p - 1].isspace()]


def decoded_bytes(enc: tiktoken.Encoding, ids: bytes) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlaps: tuple[int, ...] = OVERLAPS,
    keep: dict[str, str] | None = None,
    decoded: bool = False,
) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every text; ``ids`` little-endian unsigned 32-bit integers.

    With ``decoded``, the bytes that the ids decode to follow, as ``decode`` gives them, from the
    Python worker that has just made the ids: a task then needs one worker, not two.

    Texts of at most ``chunk_chars`` are one chunk and are encoded where they are read. Longer ones
    are cut into overlapping chunks, pre-tokenised in parallel, spliced where the boundaries
    resynchronise, and the pieces encoded in parallel; only ids are brought together.

    Null text counts as empty: no ids. Repeated rows and null ids each give a row of their own.
    Other columns are ignored, but those named in ``keep`` (with their types) go along. Special-token strings are ordinary text.
    """

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for pdf in (b.iloc[at : at + HANDED_ROWS] for b in batches for at in range(0, len(b), HANDED_ROWS)):
            ids = [np.array(enc.encode_ordinary(t), dtype="<u4").tobytes() if t else b"" for t in pdf.text]
            out = pdf.drop(columns="text").assign(n_tokens=[len(x) // 4 for x in ids], ids=ids)
            yield out.assign(decoded=[decoded_bytes(enc, x) for x in ids]) if decoded else out

    keep, made = keep or {}, ["ids", "decoded"] if decoded else ["ids"]
    made_types = "n_tokens long, " + ", ".join(f"{c} binary" for c in made)
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[F.col(c).cast(t).alias(c) for c, t in keep.items()],
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = F.length("text")
    also = "".join(f", {c} {t}" for c, t in keep.items())
    short = docs.where(size <= chunk_chars).mapInPandas(run, f"doc_id long{also}, {made_types}")
    whole = docs.where(size > chunk_chars).withColumn("uid", F.monotonically_increasing_id())
    parts = owned_parts(
        whole.select("uid", "doc_id", "text"),
        lambda part: pre_token_bounds(part, pattern), chunk_chars, overlaps, MARGIN,
    )
    encoded = parts.withColumnRenamed("part", "text").mapInPandas(run, f"uid long, doc_id long, i int, {made_types}")
    long = encoded.groupBy("uid", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"), *[F.expr(f"listagg({c}) WITHIN GROUP (ORDER BY i)").alias(c) for c in made]
    )
    if keep:
        long = long.join(whole.select("uid", *keep), "uid")
    return short.unionByName(long.select("doc_id", *keep, "n_tokens", *made))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes of the tokens in ``ids_col`` put together; null ids stay null.

    The tokens' bytes are joined as they are: nothing is replaced where they are not whole UTF-8.
    """

    @F.pandas_udf("binary")
    def to_bytes(ids: pd.Series) -> pd.Series:
        enc = encoding(ranks_path, pattern)
        return pd.Series(
            [None if x is None else decoded_bytes(enc, x) for x in ids], dtype=object
        )

    return df.withColumn("decoded", to_bytes(ids_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return out.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_byte_bpe": query}
ORACLES: dict[str, str] = {}
