"""Near-duplicate documents by SetSketch registers, bands, joint estimates and exact checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import components, saved, shared_dir, table

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    percent: int = 80  # documents are linked from this Jaccard similarity of their shingle sets on
    bands: int = 24
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    slack: float = 0.25  # a joint estimate this far below the threshold (over 5 sigma) is not verified
    memo_words: int = 400_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Shingle sets as sorted 64-bit hashes; keeps the hashes of words it has seen."""

    def __init__(self, words: int, most: int):
        super().__init__()
        self.k, self.most = words, most
        self.odd = _mix(np.arange(1, words + 1, dtype=np.uint64) * _STEP) | np.uint64(1)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        """ASCII letters in lower case, words between ASCII white space, distinct k-word shingles."""
        words = (text or "").encode().lower().split()
        if len(words) < self.k:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))] if words else [], dtype=np.uint64)
        h = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(words) - self.k + 1
        s = h[:n] * self.odd[0]
        for j in range(1, self.k):
            s = _mix(s) + h[j : j + n] * self.odd[j]
        return np.unique(_mix(s))


def sketch(items: np.ndarray, p: NearDupParams) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes.

    Each item is a Poisson process of rate ``rate * registers`` whose points fall on registers at
    random, so a register's first point over all items is exponential in the set's size. Registers
    hold its logarithm to ``base``, truncated to whole numbers of 16 bits. Sketches of two sets
    merge by maximum. Points past ``stop``, which hardly ever matter, are only made if a register
    is still open.
    """
    m, n = p.registers, len(items)
    first = np.full(m, np.inf)
    more, seen = np.log(m) + 5, 0.0
    while np.isinf(first).any():
        stop = more / (p.rate * n)
        each = m * more / n
        points = int(each + 8 * np.sqrt(each) + 8)
        z = _mix(items[:, None] + np.arange(1, points + 1, dtype=np.uint64)[None, :] * _STEP)
        gaps = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (p.rate * m)
        at = np.cumsum(gaps, axis=1)
        use = (at < stop) & (at >= seen)
        reg = ((_mix(z[use] ^ _STEP) >> np.uint64(40)) * np.uint64(m)) >> np.uint64(24)
        np.minimum.at(first, reg.astype(np.int64), at[use])
        seen, more = stop, more * 2
    return np.clip(np.floor(1 - np.log(first) / np.log(p.base)), 0, 65_535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def joint_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard of pairs of sets from their registers (rows) and known sizes.

    Registers differ upwards, downwards or not at all with probabilities that depend on the two
    sizes and the similarity; the likelihood of the three counts is concave and is searched by
    golden sections.
    """
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1 - u
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def likelihood(j):
        x, y = np.clip(prob(u - v * j), 1e-12, 1), np.clip(prob(v - u * j), 1e-12, 1)
        return up * np.log(x) + down * np.log(y) + same * np.log(np.clip(1 - x - y, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = likelihood(c) > likelihood(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


def signatures(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """``(doc_id, d1, d2, node, n_shingles, regs, keys)``: the text's digest as it came, the set's digest, size, registers and band keys."""

    def run(batches):
        shingler = Shingler(p.words, p.memo_words)
        for pdf in batches:
            rows = []
            for text in pdf.text:
                s = shingler.of(text)
                if not len(s):
                    rows.append((None, 0, None, None))
                    continue
                regs = sketch(s, p)
                bands = regs.reshape(p.bands, p.rows)
                keys = [xxhash.xxh64_intdigest(x.tobytes(), seed=i) for i, x in enumerate(bands)]
                node = hashlib.blake2b(s.tobytes(), digest_size=12).digest()
                rows.append((node, len(s), regs.tobytes(), np.array(keys, dtype=np.uint64).view(np.int64)))
            out = pd.DataFrame(rows, columns=["node", "n_shingles", "regs", "keys"])
            for i, c in enumerate(("doc_id", "d1", "d2")):
                out.insert(i, c, pdf[c].to_numpy())
            yield out

    return docs.mapInPandas(run, "doc_id long, d1 long, d2 long, node binary, n_shingles long, regs binary, keys array<long>")


def likely(pairs: DataFrame, nodes: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose joint estimate does not rule the link out."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias("n_" + x), F.col("regs").alias("r_" + x))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * p.percent)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                regs = lambda c: np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1)
                est = joint_jaccard(regs("r_a"), regs("r_b"), pdf.n_a.to_numpy(), pdf.n_b.to_numpy(), p.base)
                yield pdf.loc[est >= p.percent / 100 - p.slack, ["a", "b"]]

    return sized.mapInPandas(run, "a binary, b binary")


def linked(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs ``(a, b)`` that the full shingle sets confirm."""

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([_near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), p.percent) for x, y in zip(left, right)], dtype=bool)

    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias("s_" + x))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near("s_a", "s_b")).select("a", "b")


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def digests(text: F.Column) -> dict[str, F.Column]:
    """128 bits that tell apart different texts under one id."""
    return {"d1": F.xxhash64(text.cast("string")), "d2": F.xxhash64(F.lit(1), text.cast("string"))}


def near_duplicates(df: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    1. Every text becomes a set of distinct shingles, its SetSketch registers and band keys. Equal
       sets become one node; however many copies there are, only the node goes on.
    2. Nodes that share a band key are candidates. In each bucket all members are compared with one
       centre, the member that most others of its buckets agree with: as many pairs as members.
    3. Links are confirmed on the full sets and closed to components. Only in buckets whose members
       are not yet all in one component, members of different components are paired if what they
       lack of the centre and add to it leaves a link possible (see ``apart``) and the joint
       estimate does not rule it out; these pairs too are confirmed on the full sets.

    Pairs inside a component add nothing to it, so the components are those of all confirmed links
    among candidates. Texts without words are linked with nothing. Rows without an id take no part:
    their component is null and they are kept. Repeated rows get equal results; other columns are
    ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = grouped(docs, p).select("doc_id", "n_shingles", "component_id").withColumn("kept", F.col("doc_id") == F.col("component_id"))

    def alone(batches):
        shingler = Shingler(p.words, p.memo_words)
        for pdf in batches:
            yield pd.DataFrame({"n_shingles": [len(shingler.of(t)) for t in pdf.text]})

    no_id = docs.where("doc_id is null").select("text").mapInPandas(alone, "n_shingles long")
    no_id = no_id.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(no_id)


def grouped(docs: DataFrame, p: NearDupParams) -> DataFrame:
    """``(doc_id, d1, d2, n_shingles, component_id, first)`` of ``docs(doc_id, text)`` with an id.

    ``first`` tells whether the row's document, told by id and text, is the first of its component.
    """
    spark = docs.sparkSession
    at = shared_dir(spark)
    known = docs.where("doc_id is not null")
    sigs = saved(signatures(known.withColumns(digests(F.col("text"))), p), f"{at}/signatures")
    nodes = saved(
        sigs.where("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "d1", "d2")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("keys").alias("keys")),
        f"{at}/nodes",
    )
    every = nodes.select("node", "n_shingles", F.explode("keys").alias("key"))
    size = every.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    member = saved(every.join(size, "key"), f"{at}/members")
    weight = member.groupBy("node").agg(F.sum("members").alias("weight"))
    centre = (
        member.join(weight, "node")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "node")).alias("top"))
        .select("key", F.col("top.node").alias("centre"))
    )
    starred = member.join(centre, "key")
    stars = starred.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()

    # the full sets, of candidates only
    wanted = member.select("node").distinct().join(nodes.select("node", "rep"), "node")

    def sets_of(batches):
        shingler = Shingler(p.words, p.memo_words)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                items = [shingler.of(t).tobytes() for t in part.text]
                node = [hashlib.blake2b(s, digest_size=12).digest() for s in items]
                yield pd.DataFrame({"node": node, "items": items})

    texts = known.join(wanted.select("rep.doc_id").distinct(), "doc_id", "left_semi").select("text")
    # an id may stand on several texts; one set a node is enough
    sets = texts.mapInPandas(sets_of, "node binary, items binary").join(wanted.select("node"), "node", "left_semi")
    sets = saved(sets.dropDuplicates(["node"]), f"{at}/sets")

    links = saved(linked(stars, sets, p), f"{at}/links")
    comp = saved(components(links), f"{at}/comp")
    tagged = starred.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = tagged.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    rest = tagged.join(mixed, "key").where("node <> centre")
    edges = rest.select(F.col("node").alias("a"), F.col("centre").alias("b"), "component").distinct()
    delta = saved(deltas(edges, sets), f"{at}/delta")
    pairs = saved(likely(apart(delta, p), nodes, p), f"{at}/pairs")
    final = saved(components(links.union(linked(pairs, sets, p))), f"{at}/final")

    place = nodes.select("node", "rep").join(final.withColumnRenamed("id", "node"), "node", "left")
    place = place.withColumn("component", F.coalesce("component", "node"))
    least = place.groupBy("component").agg(F.min("rep").alias("least"))
    place = place.join(least, "component").select("node", "least")
    return sigs.join(place, "node", "left").select(
        "doc_id", "d1", "d2", "n_shingles",
        F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        (F.col("least").isNull() | (F.struct("doc_id", "d1", "d2") == F.col("least"))).alias("first"),
    )


def deltas(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """For each ``(a, b, component)``: b's size, the items of b that a lacks, those a has besides."""

    def run(batches):
        for pdf in batches:
            rows = []
            for x, y in zip(pdf.s_a, pdf.s_b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                gone, own = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                rows.append((len(y), len(gone), len(own), np.concatenate([gone, own]).view(np.int64)))
            out = pd.DataFrame(rows, columns=["size", "gone", "added", "items"])
            yield pd.concat([pdf[["a", "b", "component"]].reset_index(drop=True), out], axis=1)

    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias("s_" + x))
    return (
        edges.join(side("a"), "a")
        .join(side("b"), "b")
        .mapInPandas(run, "a binary, b binary, component binary, size long, gone long, added long, items array<long>")
    )


def apart(delta: DataFrame, p: NearDupParams) -> DataFrame:
    """Pairs of nodes with a common centre, in different components, that can still be linked.

    Two sets x and y are told apart by the items they lack of their centre c or add to it. With t
    such items in common, gone and added ones alike, they are linked only if
    (100 + P) t >= far_x + far_y + (100 - P) |c|, far = 100 gone + P added - (100 - P) |c|; far is
    positive just for nodes not linked to c, and one of the two is such. So t is at least 1, and
    mostly a large share of the smaller difference. The differences are joined on their items,
    each ordered from the rarest item to the commonest: a pair is made only at items after which
    both still have enough. What all variants of a text have in common comes last and makes none.
    """
    one = delta.withColumn("far", F.expr(f"100 * gone + {p.percent} * added - {100 - p.percent} * size"))
    each = one.select(
        F.col("a").alias("node"), "b", "component", "far", "size", F.explode("items").alias("item")
    ).withColumn("k", F.xxhash64("b", "item"))
    often = each.groupBy("k").agg(F.count("*").alias("often"))
    each = each.join(often, "k")
    after = F.row_number().over(Window.partitionBy("node", "b").orderBy(F.desc("often"), "k"))
    least = F.expr(f"if(far > 0, far, far + {100 - p.percent} * size)")
    each = each.withColumn("after", after).where((F.col("often") > 1) & (F.col("after") * (100 + p.percent) >= least))
    each = each.select("k", "node", "component", "far", "size", "after")
    x, y = each.alias("x"), each.alias("y")
    enough = F.expr(f"{100 + p.percent} * least(x.after, y.after) >= x.far + y.far + {100 - p.percent} * x.size")
    pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.component") < F.col("y.component")) & enough)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def keep_one(docs: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, columns as they were.

    Different texts under one id are documents of their own; rows equal in id and text are one.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = ["doc_id", "d1", "d2"]
    keep = grouped(rows.select("doc_id", "text"), p).where("first").select(one).distinct()
    named = rows.where("doc_id is not null").withColumns(digests(F.col("text"))).drop("text").join(keep, one, "left_semi").dropDuplicates(one)
    return named.select("_row.*").unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDupParams(words=3, percent=85))


QUERIES = {"op9_near_dup": query}
ORACLES: dict[str, str] = {}
