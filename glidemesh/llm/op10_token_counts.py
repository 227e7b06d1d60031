"""Token counts of whole texts by overlap resynchronisation."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glidemesh.llm.common import table
from glidemesh.llm.overlap import owned_parts

CHUNK_CHARS = 1 << 16
OVERLAPS = (512, 8_192, 30_000)
#: A chunk's last characters may still join what was cut off.
MARGIN = 64
#: Words whose counts a worker keeps; beyond it the table is begun anew.
MEMO_WORDS = 600_000
#: str.split() also splits at these, which the tokenizer does not count as white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    return Tokenizer.from_file(path)


class WordCounts(dict):
    """Token counts of white-space-delimited words.

    The tokenizer drops white space, which always ends a pre-token, and its normaliser composes
    nothing across it; so a text has as many tokens as its words.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tok = tokenizer(path)

    def text(self, text: str) -> int:
        if _SEPARATORS.search(text):
            return len(self.tok.encode(text, add_special_tokens=False))
        words = text.split()
        new = [w for w in set(words) if w not in self]
        if new:
            if len(self) + len(new) > MEMO_WORDS:
                self.clear()
                new = list(set(words))
            self.learn(new)
        return sum(map(self.__getitem__, words))

    def learn(self, words: list[str]) -> None:
        """Count words; a plain one is its lower-case stem and, a pre-token of its own, its stops."""
        split = [(w, *_stem(w)) for w in words]
        new = [x for x in {x for _, *both in split for x in both if x} if x not in self]
        self.update(zip(new, self.each(new)))
        self[""] = 0
        self.update([(w, self[a] + self[b]) for w, a, b in split])

    def each(self, words: list[str]) -> list[int]:
        """Tokens of each word, by offsets in one encoding of them all with spaces between."""
        if not words:
            return []
        starts = np.array([a for a, _ in self.tok.encode(" ".join(words), add_special_tokens=False).offsets])
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.diff(np.searchsorted(starts, ends), prepend=0).tolist()


def _stem(word: str) -> tuple[str, str]:
    # special strings are matched before the text is lower-cased
    if word.isascii() and "<|" not in word:
        stem = word.rstrip(".,;:!?")
        if stem and stem[-1].isalpha():
            return stem.lower(), word[len(stem) :]
    return word, ""


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def stable_bounds(part: str, path: str) -> list[int]:
    """Token starts, by the tokenizer's offsets, that come straight after white space.

    Such a start is stable: white space belongs to no token and nothing is composed across it, so
    the reading from there on is the same whatever stands before.
    """
    starts = {a for a, _ in tokenizer(path).encode(part, add_special_tokens=False).offsets}
    return sorted(p for p in starts if p and part[p - 1].isspace() and not _SEPARATORS.match(part[p - 1]))


def count_tokens(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlaps: tuple[int, ...] = OVERLAPS,
    margin: int = MARGIN,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every text, as the tokenizer file's library counts them.

    Texts longer than ``chunk_chars`` are encoded as overlapping chunks with offsets, spliced at
    stable boundaries that both chunks have; where none lie in an overlap it is widened, and at
    last the text is read whole. No begin, end or padding tokens are added; special strings in a
    text count as the library's default has it. Null text is empty: 0 tokens. Repeated rows and
    null ids each give their own row; other columns are ignored.
    """

    def run(batches):
        counts = word_counts(path)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(n_tokens=[counts.text(t) for t in pdf.text])

    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = F.length("text")
    short = (
        docs.where(size <= chunk_chars)
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
        .mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    )
    parts = owned_parts(
        docs.where(size > chunk_chars).withColumn("uid", F.monotonically_increasing_id()),
        lambda part: stable_bounds(part, path), chunk_chars, overlaps, margin,
    )
    long = (
        parts.select("uid", "doc_id", F.octet_length("part").cast("long").alias("n_bytes"), F.col("part").alias("text"))
        .mapInPandas(run, "uid long, doc_id long, n_bytes long, n_tokens long")
        .groupBy("uid", "doc_id")
        .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    )
    return short.unionByName(long.select("doc_id", "n_bytes", "n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op10_token_counts": query}
ORACLES: dict[str, str] = {}
