"""Periodic runs of words: longest common extensions by a difference cover, probed on harmonic grids."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glidemesh.llm.common import table

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class RunParams:
    repeats: int = 4  # periods that a run spans at least
    least: int = 6  # words of a run at least
    cover: int = 31  # modulus of the difference cover
    batch_words: int = 200_000  # of texts that are searched together


@lru_cache(maxsize=8)
def difference_cover(v: int) -> np.ndarray:
    """Fewest residues, so that every difference modulo ``v`` is one of two of them."""
    size = 1
    while size * (size - 1) < v - 1:
        size += 1
    while True:
        for rest in combinations(range(2, v), max(0, size - 2)):
            cover = (0, 1, *rest) if size > 1 else (0,)
            if len({(a - b) % v for a in cover for b in cover}) == v:
                return np.array(sorted(set(cover)))
        size += 1


class Extensions:
    """Longest common extensions of pairs of positions in a sequence of numbers.

    Only suffixes at sampled positions (their residue is in the cover) are sorted. Any two positions
    reach a pair of sampled ones after the same few steps, fewer than the modulus; those steps are
    compared one by one, the rest is a range minimum over the sampled suffixes' common prefixes.
    ``seq`` holds texts that begin at ``begins`` and end with a number of their own; only texts in
    which a pair agrees in all those steps are sorted.
    """

    def __init__(self, seq: np.ndarray, v: int, cover: np.ndarray, begins: np.ndarray):
        n = len(seq)
        self.v, self.begins = v, begins
        # behind the end, numbers that differ from all others and from each other
        self.seq = np.concatenate([seq, -2 - np.arange(2 * v)])
        self.steps = np.zeros((v, v), np.int64)
        inside = np.isin(np.arange(v), cover)
        for a in range(v):
            for b in range(v):
                self.steps[a, b] = next(d for d in range(v) if inside[(a + d) % v] and inside[(b + d) % v])
        self.sampled = np.flatnonzero(inside[np.arange(n) % v])

    def _sort(self, texts: np.ndarray) -> None:
        v = self.v
        wanted = np.zeros(len(self.begins), bool)
        wanted[texts] = True
        s = self.sampled[wanted[np.searchsorted(self.begins, self.sampled, side="right") - 1]]
        # the v numbers of each sample as bytes that compare like them
        wide = np.lib.stride_tricks.sliding_window_view((self.seq + (1 << 31)).astype(">u4"), v)[s]
        rank = np.unique(np.ascontiguousarray(wide).view(f"V{4 * v}").ravel(), return_inverse=True)[1].astype(np.int64)
        slot = np.full(len(self.seq) + 1, -1)
        slot[s] = np.arange(len(s))
        levels, have = [rank], v
        while rank.max(initial=0) + 1 < len(s):
            # a sample moved by a multiple of v is a sample too
            ahead = slot[np.minimum(s + have, len(self.seq))]
            after = np.where(ahead >= 0, rank[ahead], -1)
            rank = np.unique(rank * (len(s) + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
            levels.append(rank)
            have *= 2
        self.rank = np.full(len(self.seq) + 1, -1)
        self.rank[s] = rank
        order = s[np.argsort(rank)]
        x, y = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(len(x), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            at = lambda z, r=levels[k]: np.where(slot[np.minimum(z, len(self.seq))] >= 0, r[slot[np.minimum(z, len(self.seq))]], -1)
            rx, ry = at(x), at(y)
            same = (rx == ry) & (rx >= 0)
            step = (v << k) * same
            lcp, x, y = lcp + step, x + step, y + step
        self._walk(x, y, lcp, np.full(len(x), v))
        self.table = [lcp]
        while (1 << len(self.table)) <= len(lcp):
            half, t = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(t[:-half], t[half:]))

    def _walk(self, x: np.ndarray, y: np.ndarray, out: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Compare step by step, at most ``most`` steps; adds to ``out``; which pairs agree in all."""
        on = np.flatnonzero(most > 0)
        whole = most <= 0
        step = 0
        while len(on):
            on = on[self.seq[x[on] + step] == self.seq[y[on] + step]]
            out[on] += 1
            step += 1
            end = most[on] <= step
            whole[on[end]] = True
            on = on[~end]
        return whole

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many numbers from ``x`` and from ``y`` on (``x`` < ``y``) are the same."""
        out = np.zeros(len(x), np.int64)
        few = self.steps[x % self.v, y % self.v]
        on = np.flatnonzero(self._walk(x, y, out, few))
        if not len(on):
            return out
        self._sort(np.unique(np.searchsorted(self.begins, x[on], side="right") - 1))
        # both are inside, as what lies behind the end equals nothing
        a, b = self.rank[x[on] + few[on]], self.rank[y[on] + few[on]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            t = self.table[k]
            out[on[i]] += np.minimum(t[lo[i]], t[hi[i] - (1 << k)])
        return out


@lru_cache(maxsize=1_024)
def _small_grid(n: int, p: RunParams) -> tuple[np.ndarray, np.ndarray]:
    return _grid(n, p)


def _grid(n: int, p: RunParams) -> tuple[np.ndarray, np.ndarray]:
    """``(position, period)``: for every period q that a run of n words can have, each
    (repeats - 1) q-th position. A run of repeats periods has one of them together with its partner
    q words on, as (repeats - 1) q positions in it have such a partner."""
    q = np.arange(1, n // p.repeats + 1)
    count = -(-(n - q) // ((p.repeats - 1) * q))
    period = np.repeat(q, count)
    nth = np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)
    return nth * (p.repeats - 1) * period, period


def runs_of(texts: list[np.ndarray], p: RunParams = RunParams()) -> list[np.ndarray]:
    """For each sequence of non-negative numbers its runs, rows ``(start, length, period)`` in order.

    A run is a maximal stretch with smallest period q, at least ``repeats`` q and ``least`` long.
    """
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size + 1) - size - 1
    seq = np.full(int((size + 1).sum()), -1, np.int64)
    for t, b in zip(texts, begin):
        seq[b : b + len(t)] = t
    # texts end with numbers of their own
    seq[begin + size] = seq.max(initial=0) + 1 + np.arange(len(texts))
    xs, qs = [], []
    for n, b in zip(size.tolist(), begin.tolist()):
        x, q = _small_grid(n, p) if n <= 1_000 else _grid(n, p)
        hit = seq[b + x] == seq[b + x + q]
        xs.append(b + x[hit]), qs.append(q[hit])
    x = np.concatenate(xs) if xs else np.zeros(0, np.int64)
    q = np.concatenate(qs) if qs else np.zeros(0, np.int64)
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    if not len(x):
        return out
    cover = difference_cover(p.cover)
    ahead = Extensions(seq, p.cover, cover, begin)(x, x + q)
    # backwards, a text begins with the number that ends the one before
    turned = np.concatenate([[seq.max() + 1], seq[:-1]])[::-1]
    last = len(seq) - 2
    back = Extensions(turned, p.cover, cover, (len(seq) - begin - size - 1)[::-1])(last - (x + q), last - x)
    start, stop = x - back + 1, x + q + ahead
    long = (stop - start >= p.repeats * q) & (stop - start >= p.least)
    found = np.stack([start[long], stop[long], q[long]], axis=1)
    if not len(found):
        return out
    # a stretch with period q is found under the multiples of q too: the smallest is its period
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    text = np.searchsorted(begin, found[:, 0], side="right") - 1
    for i in np.unique(text):
        f = found[text == i]
        rows = np.stack([f[:, 0] - begin[i], f[:, 1] - f[:, 0], f[:, 2]], axis=1)
        out[i] = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return out


def looped(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as they are or, for a tenth of the ids, with a part of them repeated to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % period] for i in range(n - a)]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(df: DataFrame, p: RunParams = RunParams(), id_col: str = "doc_id", text_col: str = "text", loop: bool = False) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of every document: its runs ``struct<start, length,
    period>`` by start and period, in words, and the words left of it, joined by a space.

    A run is a stretch of words with smallest period q, at least ``repeats`` q and ``least`` words
    long, that no neighbouring word extends. Its words after the first q are dropped. ``loop`` lets
    a tenth of the documents, told by their id, repeat a part of theirs first.

    Texts are searched where they are read, many short ones together, without a shuffle; the work
    for one grows with n log n of its words. A task holds one of Spark's Arrow batches, which are
    bounded in bytes, or one long text. Null and empty texts have no words and no runs. Rows
    without an id are never looped. Repeated rows each give a row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group, size = [], [], 0
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                words = WORD.findall(t.as_buffer()) if t.is_valid else []
                ids.append(i), group.append(looped(words, i) if loop else words)
                size += len(words)
                if size >= p.batch_words:
                    yield _found(ids, group, p)
                    ids, group, size = [], [], 0
            if ids:
                yield _found(ids, group, p)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, FOUND)


def _found(ids: list, group: list[list[bytes]], p: RunParams) -> pa.RecordBatch:
    number: dict[bytes, int] = {}
    texts = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) for words in group]
    runs = runs_of(texts, p)
    cols = [
        pa.array(ids, pa.int64()),
        pa.array([len(w) for w in group], pa.int64()),
        pa.array([[dict(zip(("start", "length", "period"), r)) for r in x.tolist()] for x in runs], _RUNS),
        pa.array([b" ".join(collapse(w, x)) for w, x in zip(group, runs)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "collapsed"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(table(spark, sf_dir, "documents"), loop=True)
    # the greatest exact length / period: fractions are compared crosswise, so none is rounded
    better = "x.length * y.period > y.length * x.period"
    best = F.expr(f"aggregate(runs, runs[0], (y, x) -> if({better}, x, y))")
    text = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')), '')")
    return out.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": query}
#: SQL has no difference covers; the tests compare with runs found by the definition.
ORACLES: dict[str, str] = {}
