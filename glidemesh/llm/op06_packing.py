"""Token-id output: best-fit-decreasing packing into id matrices."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glidemesh.llm.common import keyed, saved, shared_dir, table
from glidemesh.llm.op01_bpe import encoding

_RUNS = re.compile(r"\s\s")


@dataclass(frozen=True)
class PackParams:
    length: int = 2_048  # tokens of a row of the matrix
    buffer_tokens: int = 4_000_000  # tokens that are packed together: bounds a task's memory
    pad_id: int = 50_256
    memo_words: int = 500_000


class TokenBytes(dict):
    """Token ids of space-led words as little-endian bytes, kept for words seen before.

    Where every run of white space is one character, a space always begins a pre-token, so a text
    can be encoded word by word; other texts are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str, most: int):
        super().__init__()
        self.enc, self.most = encoding(ranks_path, pattern), most
        self.dtype = np.dtype("<u2" if self.enc.max_token_value < 65_535 else "<u4")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[word] = np.array(self.enc.encode_ordinary(word), dtype=self.dtype).tobytes()
        return ids

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        if _RUNS.search(text):
            return np.array(self.enc.encode_ordinary(text), dtype=self.dtype)
        first, *rest = text.split(" ")
        words = ([first] if first else []) + [" " + w for w in rest]
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=self.dtype)


class Capacities:
    """Open rows by free space, with a segment tree over the amounts: which is the least that fits?"""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._count(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free space, row) of an open row with the least free space of at least ``need``."""
        i = need + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.size
        self._count(free, -1)
        return free, self.rows[free].pop()

    def _count(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.tree[i] += by
            i >>= 1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of places in ``sizes``, largest first, each where it leaves the least room."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = open_rows.take(sizes[i])
        free, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if free > sizes[i]:
            open_rows.add(free - sizes[i], row)
    return rows


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids of a packed row: they begin anew at every segment."""
    cu = np.asarray(cu_seqlens)
    return np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))


def pack(
    df: DataFrame, ranks_path: str, pattern: str, p: PackParams = PackParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode whole texts and pack their ids into rows of ``length`` tokens.

    Returns ``(pack_id, ids, n_tokens, doc_ids, pieces, cu_seqlens, resets)``: ``ids`` is a row of
    the matrix as unsigned little-endian integers (16 bits where the vocabulary fits), padded with
    ``pad_id``; segment ``k`` is ``ids[cu_seqlens[k] : cu_seqlens[k + 1]]``, piece ``pieces[k]`` of
    document ``doc_ids[k]``; ``resets`` are the places where positions begin at 0 again.

    A document longer than a row is split into full rows and a rest, so joining its pieces in order
    gives its ids. Each task packs what it reads, ``buffer_tokens`` at a time, so nothing is
    shuffled and no task holds more. Texts without tokens (null, empty) have no segment. Repeated
    rows and null ids are packed like others; other columns are ignored.
    """

    def run(batches):
        words = TokenBytes(ranks_path, pattern, p.memo_words)
        made = 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        tokens = 0

        def flush():
            nonlocal made
            rows = best_fit([len(x[2]) for x in held], p.length)
            for lo in range(0, len(rows), 512):
                out = []
                for row in rows[lo : lo + 512]:
                    segments = [held[i] for i in row]
                    ids = np.full(p.length, p.pad_id, dtype=words.dtype)
                    cu = np.cumsum([0] + [len(s[2]) for s in segments])
                    ids[: cu[-1]] = np.concatenate([s[2] for s in segments])
                    key = (TaskContext.get().partitionId() << 33) + made
                    made += 1
                    out.append((key, ids.tobytes(), int(cu[-1]), [s[0] for s in segments], [s[1] for s in segments], cu.tolist(), cu[:-1].tolist()))
                yield pd.DataFrame(out, columns=["pack_id", "ids", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "resets"])

        for pdf in batches:
            for doc, text in zip(pdf.doc_id.astype("Int64"), pdf.text):
                ids = words.of(text)
                for n, lo in enumerate(range(0, len(ids), p.length)):
                    held.append((None if doc is pd.NA else int(doc), n, ids[lo : lo + p.length]))
                tokens += len(ids)
                if tokens >= p.buffer_tokens:
                    yield from flush()
                    held, tokens = [], 0
        if held:
            yield from flush()

    return keyed(df, id_col, text_col).mapInPandas(
        run,
        "pack_id long, ids binary, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, resets array<int>",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrices are written as files and read back; a row of the result is a row of a matrix."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    packed = saved(packed, f"{shared_dir(spark)}/packed")
    return packed.select(
        "pack_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "resets", F.sha2("ids", 256).alias("ids_sha256")
    )


QUERIES = {"op6_packing": query}
ORACLES: dict[str, str] = {}
