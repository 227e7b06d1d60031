"""Ranked lexical search: exact largest inner products by sparse ball trees, in whole numbers."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import batch_setting, saved, shared_dir, small_batches, table

#: Bytes to bytes: A-Z in lower case, whatever is no part of a term a space.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


@dataclass(frozen=True)
class SearchParams:
    top: int = 50
    shard_docs: int = 8_192  # of one ball tree, about
    leaf_docs: int = 48
    item_batch: int = 128  # items that are searched together in a shard
    block_bytes: int = 1 << 20  # of item texts whose terms are broadcast together


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of each document with a term: how many terms it has in all, and
    those of the vocabulary with their counts, as little-endian 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = terms(bytes(t.as_buffer())) if t.is_valid else []
                if words:
                    held = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                    both = np.array(held, "<i4").reshape(-1, 2)
                    rows.append((i, len(words), both[:, 0].tobytes(), both[:, 1].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_counts(vecs: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is; summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), "<i4"), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in vecs.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Rows:
    """Sparse rows of whole numbers: columns and values of row i are those from ``ptr[i]`` to ``ptr[i + 1]``."""

    def __init__(self, cols: np.ndarray, vals: np.ndarray, ptr: np.ndarray):
        self.cols, self.vals, self.ptr = cols, vals, ptr

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = (self.ptr[1:] - self.ptr[:-1])[rows]
        ptr = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ptr[-1]) + np.repeat(self.ptr[rows] - ptr[:-1], size)
        return Rows(self.cols[at], self.vals[at], ptr)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums of one number an entry by rows; rows may be empty."""
        run = np.concatenate([[0], np.cumsum(x)])
        return run[self.ptr[1:]] - run[self.ptr[:-1]]

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return self.sums(self.vals * dense[self.cols])


def _ceil_root(x: np.ndarray) -> np.ndarray:
    """The least whole number whose square is at least ``x``, itself whole."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r >= x  # from below, so that rounding does not matter
    r = np.maximum(r - 1, 0)
    while (low := r * r < x).any():
        r += low
    return r


class BallTree:
    """Balls around rounded centroids over sparse rows.

    Centroids are whole numbers, so squared distances, products and bounds are exact in 64 bits, and
    radii and norms are rounded up: a bound is never below a product in its ball.
    """

    def __init__(self, x: Rows, width: int, leaf: int):
        self.children: list[tuple[int, int] | None] = []
        self.leaf: list[tuple[int, int]] = []
        self.radius: list[int] = []
        self.centres: list[tuple[np.ndarray, np.ndarray]] = []
        norms = x.sums(x.vals * x.vals)
        order: list[np.ndarray] = []
        self._placed = 0
        self._grow(x, norms, np.arange(len(x)), width, leaf, order)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.rows = x.take(self.order)

    def _grow(self, x: Rows, norms: np.ndarray, ids: np.ndarray, width: int, leaf: int, order: list) -> int:
        me, part, own = len(self.radius), x.take(ids), norms[ids]
        centre = np.bincount(part.cols, weights=part.vals, minlength=width)
        centre = np.rint(centre / len(ids)).astype(np.int64)
        away = own - 2 * part.dot(centre) + int((centre * centre).sum())
        self.radius.append(int(_ceil_root(away.max(keepdims=True))[0]))
        held = np.flatnonzero(centre)
        self.centres.append((held, centre[held]))
        self.children.append(None)
        self.leaf.append((0, 0))
        if len(ids) <= leaf or not away.any():
            self.leaf[me] = (self._placed, self._placed + len(ids))
            self._placed += len(ids)
            order.append(ids)
            return me
        # two rows far apart, and the half that is nearer to either
        first = self._distances(part, own, int(away.argmax()), width)
        second = self._distances(part, own, int(first.argmax()), width)
        side = np.argsort(first - second, kind="stable")
        half = len(ids) // 2
        self.children[me] = tuple(self._grow(x, norms, ids[np.sort(s)], width, leaf, order) for s in (side[:half], side[half:]))
        return me

    @staticmethod
    def _distances(part: Rows, own: np.ndarray, i: int, width: int) -> np.ndarray:
        to = np.zeros(width, np.int64)
        lo, hi = part.ptr[i], part.ptr[i + 1]
        to[part.cols[lo:hi]] = part.vals[lo:hi]
        return own - 2 * part.dot(to) + own[i]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the products of each ball's rows with each row of ``q``, ``(balls, queries)``."""
        used = np.flatnonzero(q.any(axis=0))
        place = np.full(q.shape[1], -1)
        place[used] = np.arange(len(used))
        centre = np.zeros((len(self.centres), len(used)))
        for k, (cols, vals) in enumerate(self.centres):
            at = place[cols]
            centre[k, at[at >= 0]] = vals[at >= 0]
        # products of whole numbers below 2**53 are exact in doubles
        small = q[:, used].sum(axis=1).max(initial=0) * centre.max(initial=0) < 2.0**53
        near = (centre @ q[:, used].T.astype(np.float64)).astype(np.int64) if small else centre.astype(np.int64) @ q[:, used].T
        return near + np.array(self.radius)[:, None] * _ceil_root((q * q).sum(axis=1))[None, :]

    def search(self, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` rows with the largest positive product with ``q``, ties by smaller id:
        their ids and products. Balls are opened best first until none can hold a better row."""
        best_s, best_i, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        heap = [(-int(bound[0]), 0)] if len(bound) else []
        while heap:
            up, node = heapq.heappop(heap)
            if -up < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    # a child's rows are in its parent's ball too
                    heapq.heappush(heap, (max(up, -int(bound[child])), child))
                continue
            lo, hi = self.leaf[node]
            a, b = self.rows.ptr[lo], self.rows.ptr[hi]
            run = np.concatenate([[0], np.cumsum(self.rows.vals[a:b] * q[self.rows.cols[a:b]])])
            ptr = self.rows.ptr[lo : hi + 1] - a
            score = run[ptr[1:]] - run[ptr[:-1]]
            good = score >= least
            if not good.any():
                continue
            best_s = np.concatenate([best_s, score[good]])
            best_i = np.concatenate([best_i, ids[self.order[lo:hi][good]]])
            if len(best_s) >= top:
                pick = np.lexsort((best_i, -best_s))[:top]
                best_s, best_i = best_s[pick], best_i[pick]
                if len(best_s) == top:
                    least = int(best_s[-1])  # an equal product may have a smaller id
        pick = np.lexsort((best_i, -best_s))
        return best_i[pick], best_s[pick]


def _search_shard(rows: list, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, p: SearchParams):
    """``(item_id, doc_id, score)`` arrays of a shard's best documents for each item."""
    size = np.array([len(r[2]) // 4 for r in rows])
    cols = np.frombuffer(b"".join(r[2] for r in rows), "<i4").astype(np.int64)
    tf = np.frombuffer(b"".join(r[3] for r in rows), "<i4").astype(np.int64)
    m = np.array([50 + 50 * r[1] * n_docs // n_terms for r in rows], np.int64)
    vals = 1_000_000_000 * tf // (1_000 * tf + 20 * np.repeat(m, size))
    ids = np.array([r[0] for r in rows], np.int64)
    tree = BallTree(Rows(cols, vals, np.concatenate([[0], np.cumsum(size)])), len(weights), p.leaf_docs)
    for lo in range(0, len(items), p.item_batch):
        part = items[lo : lo + p.item_batch]
        q = np.zeros((len(part), len(weights)), np.int64)
        for k, (_, t) in enumerate(part):
            q[k, t] = weights[t]
        bound = tree.bounds(q)
        for k, (item, _) in enumerate(part):
            found, score = tree.search(q[k], bound[:, k], ids, p.top)
            if len(found):
                yield np.full(len(found), item), found, score


FOUND = "item_id long, doc_id long, score long, shard long"


def _search_block(docs: DataFrame, texts: dict[int, set[bytes]], p: SearchParams, at: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))}
    items = [(i, np.array(sorted(vocabulary[t] for t in ts), np.int64)) for i, ts in sorted(texts.items())]
    vecs = saved(vectors(docs, vocabulary), at)
    n_docs, n_terms = vecs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(vecs, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((items, weights))
    shards = max(1, -(-n_docs // p.shard_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        rows, now = [], None

        def flush():
            out = list(_search_shard(rows, items, weights, n_docs, n_terms, p))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(np.full(len(cols[0]), now))], names=["item_id", "doc_id", "score", "shard"])

        for batch in batches:
            for shard, *row in zip(*(batch[c].to_pylist() for c in ("shard", "doc_id", "n", "terms", "tfs"))):
                if rows and shard != now:
                    yield from flush()
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield from flush()

    dealt = vecs.where(F.length("terms") > 0).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for each of ``items(item_id, text)`` the ``top`` documents
    of ``docs(doc_id, text)`` with the highest score above 0, equal ones by smaller id.

    A document's score for an item is the inner product of the weights of the item's terms, each
    once, with the document's damped counts of them; all in whole numbers but the logarithm.

    1. Items go in blocks of about ``block_bytes`` of text; a block's terms are broadcast. One pass
       over the documents keeps how many terms each has and its counts of the block's terms.
    2. Documents are dealt by id to shards of about ``shard_docs``. A shard's vectors form a ball
       tree, which every item of the block descends best first; balls whose bound is below the last
       of the best are left closed. The shards' best are merged in two steps.

    The result does not depend on the shards. Null or empty texts have no terms; such documents do
    not count. Documents and items without an id take no part. Repeated documents are ranked each;
    texts under one item id are one item. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    at = shared_dir(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    items = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks, found = max(1, -(-size // p.block_bytes)), []
    for b in range(blocks):
        texts: dict[int, set[bytes]] = {}
        for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator():
            texts.setdefault(r.item_id, set()).update(terms(r.text.encode()))
        if any(texts.values()):
            found.append(_search_block(docs, texts, p, f"{at}/vectors-{b}"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    every = reduce(DataFrame.union, found).withColumn("part", F.pmod("shard", F.lit(32)))
    some = every.withColumn("rank", best("item_id", "part")).where(F.col("rank") <= p.top)
    return some.withColumn("rank", best("item_id")).where(F.col("rank") <= p.top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with batch_setting(spark):
        return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = """
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE item_id IS NOT NULL
), words AS (
  SELECT kind, id, unnest(regexp_extract_all(text, '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM folded
), tf AS (SELECT id AS doc_id, term, count(*) AS tf FROM words WHERE kind = 'd' GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
asked AS (SELECT DISTINCT id AS item_id, term FROM words WHERE kind = 'i'),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), total GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

QUERIES = {"op12_lexical_search": query}
ORACLES: dict[str, str] = {"op12_lexical_search": SQL}
