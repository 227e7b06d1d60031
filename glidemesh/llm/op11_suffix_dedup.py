"""Removal of repeated byte strings by longest-previous-factor arrays over sparse suffix orders."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import batch_setting, saved, shared_dir, small_batches, table

GRAM = 32  # bytes hashed at each position, four words of eight
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK = 1 << 15
DOC = ["doc_id", "d1"]


@dataclass(frozen=True)
class RepeatParams:
    length: int = 100  # bytes that a string must share with an earlier one
    most_starts: int = 1_024  # of one piece
    chunk_pieces: int = 1_024  # of one bucket that are put in suffix order together
    batch_bytes: int = 1 << 16


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from every position on."""
    n = len(buf) - GRAM + 1
    word = np.ndarray(shape=(len(buf) - 7,), dtype=np.uint64, buffer=buf, strides=(1,))
    h = word[:n] * _ODD[0]
    for j in range(1, GRAM // 8):
        h += word[8 * j : 8 * j + n] * _ODD[j]
    h ^= h >> np.uint64(32)
    h *= _MIX1
    h ^= h >> np.uint64(29)
    h *= _MIX2
    return h


def _windows(h: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours from a position on."""
    at = 1
    while at * 2 <= width:
        h = best(h[:-at], h[at:])
        at *= 2
    rest = width - at
    return best(h[: len(h) - rest], h[rest:]) if rest else h


def _again_near(h: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Keys that stand at several grams of the block, so that one piece may hold a string twice."""
    pad = np.zeros(width - 1, np.uint64)
    chosen = h[h == _windows(np.concatenate([pad, low, pad]), width, np.maximum)]
    chosen.sort()
    return np.unique(chosen[1:][chosen[1:] == chosen[:-1]])


def piece_bounds(buf: np.ndarray, ends: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, first, starts, own)`` of the pieces of texts put one behind the other, which end at ``ends``.

    A string of ``length`` bytes has the least of its gram hashes as its key, so equal strings have
    equal keys. A piece is a run of neighbouring starts of one text with one key, at most
    ``most_starts`` of them: every start of a text lies in just one piece. ``own`` is 1 where a piece
    may repeat a string of its own.
    """
    width = p.length - GRAM + 1
    keys, firsts, counts, own = [], [], [], []
    begins = np.concatenate([[0], ends[:-1]])
    total = len(buf)
    for lo in range(0, total, BLOCK):
        hi = min(lo + BLOCK, total - p.length + 1)
        if hi <= lo:
            break
        grams = _gram_hashes(buf[lo : hi + p.length - 1])
        low = _windows(grams, width, np.minimum)
        at = np.arange(lo, hi)
        text = np.searchsorted(ends, at, side="right")
        fits = at + p.length <= ends[text]
        cut = np.empty(len(at), bool)
        cut[0] = True
        cut[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1]) | ((at[1:] - begins[text[1:]]) % p.most_starts == 0)
        starts = np.flatnonzero(cut)
        # a text's starts that fit come first, so a run is cut short where they end
        size = np.add.reduceat(fits, starts)
        some = size > 0
        keys.append(low[starts][some])
        firsts.append(at[starts][some])
        counts.append(size[some])
        own.append(np.isin(keys[-1], _again_near(grams, low, width)).astype(np.int64))
    if not keys:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in (keys, firsts, counts, own))


PIECES = "h long, c long, doc_id long, d1 long, a long, n long, own long"


def pieces(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """A row for every piece of ``docs(doc_id, d1, text)``: key, digest, text, first start, starts.

    A task makes a text's pieces once, not for each of its copies, unless a copy has a smaller id
    than those before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, int] = {}
        for batch in batches:
            ids, d1, texts, sizes = [], [], [], []
            for i, d, t in zip(batch["doc_id"].to_pylist(), batch["d1"].to_pylist(), batch["text"]):
                raw = t.as_buffer()
                if raw is None or raw.size < p.length:
                    continue
                digest = hashlib.blake2b(raw, digest_size=12).digest()
                if least.get(digest, i + 1) <= i:
                    continue
                least[digest] = i
                ids.append(i), d1.append(d), texts.append(raw), sizes.append(raw.size)
            if not ids:
                continue
            whole = b"".join(texts)
            ends = np.cumsum(sizes)
            key, first, count, own = piece_bounds(np.frombuffer(whole, np.uint8), ends, p)
            view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
            same = np.fromiter((digest(view[a : a + n]) for a, n in zip(first.tolist(), (count + p.length - 1).tolist())), np.uint64, len(first))
            text = np.searchsorted(ends, first, side="right")
            start = first - (ends - np.array(sizes))[text]
            cols = [key.view(np.int64), same.view(np.int64), np.array(ids, np.int64)[text], np.array(d1, np.int64)[text], start, count, own]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", "c", "doc_id", "d1", "a", "n", "own"])

    return docs.mapInArrow(run, PIECES)


MARKS = "h long, chunk long, doc_id long, d1 long, a long, n long"


def marks(found: DataFrame, p: RepeatParams) -> DataFrame:
    """Pieces with a key that another piece has: those equal to an earlier one, ``chunk`` null, and
    the first of each of the different ones, in chunks of ``chunk_pieces`` under a key.

    Keys of one piece, or of one and its copies, need no suffix order and drop out here, but where
    the piece may repeat a string of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, as an array of its columns
        held, place = None, -1  # the first piece of a key that so far has no other; pieces of the key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch[c].to_numpy() for c in ("h", "c", "doc_id", "d1", "a", "n", "own")])
            prev = np.concatenate([last[:, None] if last is not None else ~x[:, :1], x[:, :-1]], axis=1)
            last = x[:, -1].copy()
            diff = x != prev
            new_h = diff[0]
            new_c = new_h | diff[1]
            again = ~diff[:5].any(axis=0)  # a repeated row
            copy = x[:, ~new_c & ~again]
            reps, head = x[:, new_c], new_h[new_c]
            # the place of each under its key, counted on from the batch before
            at = np.arange(reps.shape[1])
            since = np.maximum.accumulate(np.where(head, at, -1))
            order = np.where(since >= 0, at - since, at + place + 1)
            if held is not None:
                reps, head, order = np.concatenate([held, reps], axis=1), np.concatenate([[True], head]), np.concatenate([[0], order])
                held = None
            out = [(copy, None)]
            if reps.shape[1]:
                place = int(order[-1])
                alone = (order == 0) & np.concatenate([head[1:], [True]]) & (reps[6] == 0)
                if alone[-1]:
                    held, alone = reps[:, -1:], alone[:-1]
                    reps, order = reps[:, :-1], order[:-1]
                out.append((reps[:, ~alone], order[~alone] // p.chunk_pieces))
            for rows, chunk in out:
                if rows.shape[1]:
                    cols = [pa.array(rows[0]), pa.nulls(rows.shape[1], pa.int64()) if chunk is None else pa.array(chunk, pa.int64()), *(pa.array(r) for r in rows[2:6])]
                    yield pa.RecordBatch.from_arrays(cols, names=["h", "chunk", "doc_id", "d1", "a", "n"])

    return found.repartition("h").sortWithinPartitions("h", "c", "doc_id", "d1", "a").mapInArrow(run, MARKS)


def suffix_ranks(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The place of each start's suffix in the order of first ``length`` bytes; equal ones share it.

    Ranks of eight bytes are joined, as many as fit 64 bits, to ranks of longer strings, the last
    ones with an overlap. ``length`` is at least eight, and ``starts`` have so many bytes behind them.
    """
    word = np.ndarray(shape=(len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,)).astype(np.uint64)
    bits = len(buf).bit_length()
    rank, have = np.unique(word, return_inverse=True)[1].astype(np.uint64), 8
    if length == 8:
        return rank[starts]
    while True:
        parts = min(64 // bits, -(-length // have))
        last = parts * have >= length
        at = starts if last else np.arange(len(buf) - parts * have + 1)
        key = rank[at]
        for k in range(1, parts):
            key = (key << np.uint64(bits)) | rank[at + (length - have if last and k == parts - 1 else k * have)]
        rank, have = np.unique(key, return_inverse=True)[1].astype(np.uint64), parts * have
        if last:
            return rank


def smaller_before(pos: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1."""
    near = np.arange(-1, len(pos) - 1)
    open_ = np.flatnonzero((near >= 0) & (pos[near] >= pos))
    while len(open_):
        near[open_] = near[near[open_]]
        open_ = open_[(near[open_] >= 0) & (pos[near[open_]] >= pos[open_])]
    return near


def longest_previous(ranks: np.ndarray) -> np.ndarray:
    """Whether each position's longest previous factor spans the ranked length.

    Of all earlier positions the two that share most with a position are, in suffix order, the
    nearest with a smaller position on either side (previous and next smaller values). Suffixes of
    one rank share the whole length and are ordered by position.
    """
    order = np.argsort(ranks, kind="stable")
    r = ranks[order]
    n = len(order)
    psv = smaller_before(order)
    nsv = n - 1 - smaller_before(order[::-1])[::-1]
    full = np.zeros(n, bool)
    has = psv >= 0
    full[has] = r[psv[has]] == r[has]
    has = nsv < n
    full[has] |= r[nsv[has]] == r[has]
    out = np.empty(n, bool)
    out[order] = full
    return out


SPANS = "doc_id long, d1 long, a long, e long, k1 long, k2 long"


def repeated_starts(cut: DataFrame, p: RepeatParams) -> DataFrame:
    """Spans ``[a, e)`` of ``cut(h, chunk, doc_id, d1, a, piece)`` that repeat an earlier string of
    their chunk; from full chunks besides every first string, under its digest ``(k1, k2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("h", "chunk", "doc_id", "d1", "a", "piece"))):
                if rows and row[:5] == rows[-1][:5]:
                    continue
                if size >= p.batch_bytes and row[:2] != rows[-1][:2]:
                    yield from _spans(rows, p)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield from _spans(rows, p)

    return cut.repartition("h", "chunk").sortWithinPartitions("h", "chunk", "doc_id", "d1", "a").mapInArrow(run, SPANS)


def _spans(rows: list, p: RepeatParams) -> Iterator[pa.RecordBatch]:
    members = Counter(r[:2] for r in rows)
    # in text order, so that smaller positions are earlier ones (equal strings have one key)
    rows = sorted(rows, key=lambda r: r[2:5])
    size = np.array([len(r[5]) for r in rows])
    raw = b"".join(r[5] for r in rows)
    ends = np.cumsum(size)
    count = size - p.length + 1
    piece = np.repeat(np.arange(len(rows)), count)
    inner = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    starts = (ends - size)[piece] + inner
    again = longest_previous(suffix_ranks(np.frombuffer(raw, np.uint8), starts, p.length))
    doc, d1, a = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    head = again & ((inner == 0) | ~np.concatenate([[False], again[:-1]]))
    tail = again & ((inner == count[piece] - 1) | ~np.concatenate([again[1:], [False]]))
    i, j = np.flatnonzero(head), np.flatnonzero(tail)
    at = piece[i]
    none = pa.nulls(len(i), pa.int64())
    yield _batch(doc[at], d1[at], a[at] + inner[i], a[at] + inner[j] + p.length, none, none)

    # strings of full chunks may have come earlier in another chunk of their key
    full = np.array([r[1] > 0 or members[r[:2]] >= p.chunk_pieces for r in rows])
    k = np.flatnonzero(full[piece] & ~again)
    if len(k):
        view, at = memoryview(raw), piece[k]
        digest = [hashlib.blake2b(view[s : s + p.length], digest_size=16).digest() for s in starts[k].tolist()]
        two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
        first = a[at] + inner[k]
        yield _batch(doc[at], d1[at], first, first + p.length, pa.array(two[:, 0]), pa.array(two[:, 1]))


def _batch(doc, d1, a, e, k1, k2) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, d1, a, e)), k1, k2], names=["doc_id", "d1", "a", "e", "k1", "k2"])


def copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, d1, a, e)``: whole texts that a smaller id has too, of ``docs(doc_id, d1, d2, n_bytes)``.

    A text's least id is found per part of its ids first, so no task sees all copies of a text.
    """
    same = ["d1", "d2"]
    part = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    few = part.groupBy(*same, "part").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = few.groupBy(*same).agg(F.min("least").alias("first"), F.max("most").alias("most")).where("first < most").drop("most")
    dealt = few.select(*same, "part").join(least, same)
    out = part.join(dealt, [*same, "part"]).where("doc_id > first")
    return out.select("doc_id", "d1", F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("e"))


def covered(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """``(doc_id, d1, spans)``: for each text with any, the byte ranges ``struct<a, e>`` that repeat
    an earlier string, in no order and overlapping, of ``docs(doc_id, d1, d2, text)``."""
    at = shared_dir(docs.sparkSession)
    found = saved(marks(pieces(docs.select("doc_id", "d1", "text"), p), p), f"{at}/marks")
    wanted = found.where("chunk is not null").groupBy(*DOC).agg(F.collect_list(F.struct("h", "chunk", "a", "n")).alias("want"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, d, want, t in zip(batch["doc_id"].to_pylist(), batch["d1"].to_pylist(), batch["want"].to_pylist(), batch["text"]):
                view = memoryview(t.as_buffer())
                rows += [(w["h"], w["chunk"], i, d, w["a"], bytes(view[w["a"] : w["a"] + w["n"] + p.length - 1])) for w in want]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["h", "chunk", "doc_id", "d1", "a", "piece"])

    parts = docs.select(*DOC, "text").join(wanted, DOC).mapInArrow(cut, "h long, chunk long, doc_id long, d1 long, a long, piece binary")
    spans = saved(repeated_starts(parts, p), f"{at}/spans")
    cross = spans.where("k1 is not null").withColumn("nth", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("doc_id", "d1", "a")))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    whole = copies(docs.select(*DOC, "d2", size).where(F.col("n_bytes") >= p.length))
    every = [
        found.where("chunk is null").select(*DOC, "a", (F.col("a") + F.col("n") + p.length - 1).alias("e")),
        spans.where("k1 is null").select(*DOC, "a", "e"),
        cross.where("nth > 1").select(*DOC, "a", "e"),
        whole,
    ]
    out = every[0]
    for x in every[1:]:
        out = out.union(x)
    return out.groupBy(*DOC).agg(F.collect_list(F.struct("a", "e")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint maximal ranges that cover the same bytes, in order."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((a, e))
    return out


def drop_repeats(df: DataFrame, p: RepeatParams = RepeatParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` of every document: the removed byte ranges
    ``array<struct<a, e>>``, maximal and in order, and the bytes that are left.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a smaller id
    or before in the same text. All is judged on the input.

    1. Each start of such a string has as its key the least gram hash in it. Runs of starts with one
       key are pieces; only pieces whose key comes again go on, of equal ones just the first.
    2. Pieces of one key, in text order, are put in the suffix order of their starts; the longest
       previous factor of a start, by previous and next smaller positions, tells whether the string
       came before. Keys with many different pieces are split into chunks; what is first in its
       chunk is compared with the other chunks' firsts by digest, so no key is in one task.
    3. Whole texts that a smaller id has too are taken as such.

    Null texts are empty. Rows without an id take no part and are kept whole. Rows equal in id and
    text are one document and get equal results; different texts under one id come one after the
    other in the order of a digest. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"), "text")
    small_batches(df.sparkSession)
    gone = covered(docs, p)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"].to_pylist()):
                view = memoryview(t.as_buffer())
                spans = merge_spans([(s["a"], s["e"]) for s in spans or []])
                begins, stops = [0, *(e for _, e in spans)], [*(a for a, _ in spans), len(view)]
                out.append((i, len(view), [{"a": a, "e": e} for a, e in spans], b"".join(view[x:y] for x, y in zip(begins, stops))))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("e", pa.int64())])), pa.binary()))],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    kept = docs.select(*DOC, "text").join(gone, DOC, "left").select("doc_id", "text", "spans")
    kept = kept.mapInArrow(keep, "doc_id long, n_bytes long, spans array<struct<a:long,e:long>>, kept binary")
    alone = rows.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("cast(array() as array<struct<a:long,e:long>>)").alias("spans"), F.encode("text", "UTF-8").alias("kept")
    )
    return kept.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with batch_setting(spark):
        out = drop_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.e - s.a)
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op11_suffix_dedup": query}
#: SQL has no suffix order, and one row for each byte of every text is out of its reach.
ORACLES: dict[str, str] = {}
