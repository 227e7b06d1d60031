"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glidemesh.llm.common import components, saved, shared_dir, table


@dataclass(frozen=True)
class LineParams:
    edits: int = 2
    near_chars: int = 24  # shorter lines are only matched exactly
    least_chars: int = 1  # shorter lines, by what is left without blanks at their ends, are left alone
    broadcast_ids: int = 500_000  # candidate line ids, 8 bytes each, that are broadcast; more are joined by shuffle
    hot_members: int = 32  # lines under one key from which their letter counts are compared first
    letters: str = "etaoinshrdlucmfwypvbgk .,"


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of two strings is at most ``edits``.

    Equal ends are cut off. Of the matrix only the band of 2 * edits + 1 diagonals is followed, as
    one bit vector for each number of errors: bit k of vector d says that b's first j characters
    and a's first j - edits + k ones are at most d edits apart.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    n, lo, hi = min(len(a), len(b)), 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    width = 2 * edits + 1
    full = (1 << width) - 1
    # row 0: i = k - edits characters of a against none of b
    rows = [sum(1 << (edits + i) for i in range(d + 1) if edits + i < width) for d in range(edits + 1)]
    for j, c in enumerate(b, 1):
        match = 0
        for k in range(max(0, edits - j + 1), min(width, len(a) - j + edits + 1)):
            if a[j - edits + k - 1] == c:
                match |= 1 << k
        new = [rows[0] & match]
        for d in range(1, edits + 1):
            new.append(((rows[d] & match) | rows[d - 1] | (rows[d - 1] >> 1) | (new[d - 1] << 1)) & full)
        low, high = edits - j, len(a) - j + edits  # bits whose i is below 0 or past the end
        keep = full & ~((1 << low) - 1 if low > 0 else 0) & ((1 << (high + 1)) - 1 if high >= 0 else 0)
        rows = [r & keep for r in new]
        if not rows[edits]:
            return False
    end = len(a) - len(b) + edits
    return 0 <= end < width and bool(rows[edits] >> end & 1)


def _segment(size: str, i: int, k: int) -> tuple[str, str]:
    """SQL for the first position (from 0) and the length of segment i of k of a line of ``size``."""
    extra = f"({size} % {k})"
    return f"({i} * ({size} div {k}) + greatest(0, {i} - {k} + {extra}))", f"({size} div {k} + if({i} >= {k} - {extra}, 1, 0))"


def _key(size: str, i: int, start: str, length: str) -> str:
    return f"xxhash64({size}, {i}, substring(line, {start} + 1, {length}))"


def index_keys(edits: int) -> str:
    """SQL array of the keys of a line's own edits + 1 segments."""
    k = edits + 1
    return f"array({', '.join(_key('n', i, *_segment('n', i, k)) for i in range(k))})"


def probe_keys(edits: int) -> str:
    """SQL array of the keys under which lines up to ``edits`` shorter can be found.

    Of a segment's possible shifts only those are probed for which the part to its left and the
    part to its right can both be matched with the edits that are left; the unshifted probe of
    lines of equal length is the index key itself.
    """
    k, keys = edits + 1, []
    for less in range(edits + 1):
        size = f"(n - {less})"
        for i in range(k):
            start, length = _segment(size, i, k)
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if less or shift:
                    keys.append(_key(size, i, f"({start} + {shift})", length))
    return f"array({', '.join(keys)})"


def _meet(index: DataFrame, probes: DataFrame, also: "F.Column") -> DataFrame:
    """Pairs ``(a, b)`` of lines that an index key brings together with another index key or a probe."""
    x, y = index.alias("x"), index.alias("y")
    level = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h1") < F.col("y.h1")) & also)
    z = probes.alias("y")
    other = x.join(z, (F.col("x.key") == F.col("y.key")) & (F.col("x.h1") != F.col("y.h1")) & also)
    return level.select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b")).union(
        other.select(F.least("x.h1", "y.h1").alias("a"), F.greatest("x.h1", "y.h1").alias("b"))
    )


def lines_of(docs: DataFrame, p: LineParams) -> DataFrame:
    """``(uid, doc_id, line_no, line, h1, h2)`` of lines that may be dropped; h1, h2: 128 bits of hash."""
    each = docs.select("uid", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    each = each.where(F.length(F.btrim("line", F.lit(" \t\r"))) >= p.least_chars)
    return each.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def with_uid(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows under fixed names; the uid tells apart different texts that bear one id."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("uid", F.xxhash64("doc_id", "text"))


def line_classes(df: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h1, h2, first, copies, links, class)`` of every distinct line that is not the only one of its class.

    ``first`` and ``class`` are places ``(doc_id, uid, line_no)``: where the line, and the earliest
    line of its class, stand first. Lines of at least ``near_chars`` characters within ``edits``
    edits are linked, and links are closed to classes; ``links`` is the number of other distinct
    lines a line is linked to.

    Each distinct line is split into ``edits`` + 1 segments, of which one at least survives so many
    edits, and looked up under substrings of fitting lengths and places; copies are put together
    before, once and for all steps, so a line that a third of all texts hold is looked up once. Under keys of more than
    ``hot_members`` lines a pair is only made if the counts of ``letters`` differ by two an edit at
    most, which no link exceeds. All candidates are verified by banded bit-parallel edit distance
    on whole lines.
    """
    at = shared_dir(df.sparkSession)
    lines = lines_of(with_uid(df, id_col, text_col), p)
    place = F.struct("doc_id", "uid", "line_no")
    distinct = lines.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.count("*").alias("copies"), *([F.first("line").alias("line")] if p.edits else [])
    )
    if p.edits:  # counted once here, as every key asks for it several times over
        distinct = distinct.withColumn("n", F.length("line"))
    distinct = saved(distinct, f"{at}/distinct", "zstd")
    if p.edits:
        long = distinct.select("h1", "h2", "line", "n").where(f"n >= {p.near_chars}")
        keyed = lambda sql: long.select(F.explode(F.expr(sql)).alias("key"), "h1", "line")
        index, probes = keyed(index_keys(p.edits)), keyed(probe_keys(p.edits))
        hot = index.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {p.hot_members}")
        hot = saved(hot.select("key", F.lit(True).alias("hot")), f"{at}/hot")
        if hot.count() <= p.broadcast_ids:
            hot = F.broadcast(hot)
        # letters are only counted where a key is hot
        counts = ", ".join(f"length(lower(line)) - length(replace(lower(line), '{c}', ''))" for c in p.letters)
        with_counts = lambda rows: rows.join(hot, "key", "left").select("key", "h1", F.expr(f"if(hot, array({counts}), null)").alias("c"))
        apart = "aggregate(zip_with(x.c, y.c, (s, t) -> abs(s - t)), 0, (s, v) -> s + v)"
        both = _meet(with_counts(index), with_counts(probes), F.expr(f"x.c is null or {apart} <= {2 * p.edits}"))
        candidates = saved(both.distinct(), f"{at}/candidates")
        ids = candidates.select(F.col("a").alias("h1")).union(candidates.select("b")).distinct()
        if ids.count() <= p.broadcast_ids:
            ids = F.broadcast(ids)
        texts = saved(long.select("h1", "h2", "line").join(ids, "h1", "left_semi"), f"{at}/texts")

        @F.pandas_udf("boolean")
        def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for left, right in batches:
                yield pd.Series([within(s, t, p.edits) for s, t in zip(left, right)], dtype=bool)

        side = lambda c: texts.select(F.col("h1").alias(c), F.struct("h1", "h2").alias(c + "_id"), F.col("line").alias(c + "_line"))
        links = candidates.join(side("a"), "a").join(side("b"), "b").where(near("a_line", "b_line"))
        links = saved(links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), f"{at}/links")
    else:
        links = df.sparkSession.createDataFrame([], "a struct<h1:long,h2:long>, b struct<h1:long,h2:long>")
    comp = components(links).select("id.*", "component")
    degree = links.select("a").union(links.select("b")).toDF("id").groupBy("id").agg(F.count("*").alias("links")).select("id.*", "links")
    told = distinct.select("h1", "h2", "first", "copies").join(comp.join(degree, ["h1", "h2"]), ["h1", "h2"], "left").where("copies > 1 or component is not null")
    told = saved(told.withColumn("component", F.coalesce("component", F.struct("h1", "h2"))), f"{at}/told")
    heads = told.groupBy("component").agg(F.min("first").alias("class"))
    out = told.join(heads, "component").select("h1", "h2", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class")
    return saved(out, f"{at}/classes")


def dropped_lines(df: DataFrame, p: LineParams = LineParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(uid, doc_id, line_no, dropped, links, kept_in, class)`` of every line that has a match.

    A line is dropped unless it is the earliest place of its class; ``kept_in`` is the document of
    that place.
    """
    lines = lines_of(with_uid(df, id_col, text_col), p)
    found = lines.select("uid", "doc_id", "line_no", "h1", "h2").join(line_classes(df, p, id_col, text_col), ["h1", "h2"])
    here = F.struct("doc_id", "uid", "line_no")
    return found.select("uid", "doc_id", "line_no", (here != F.col("class")).alias("dropped"), "links", F.col("class.doc_id").alias("kept_in"))


def dedup_lines(df: DataFrame, p: LineParams = LineParams()) -> DataFrame:
    """The documents without the lines that an earlier place (by doc_id, then line) already has.

    Blank lines are left alone. Every other line is matched, one of at least ``near_chars`` with up
    to ``edits`` edits (at most a twelfth of it), a shorter one exactly; what stays keeps its order.
    A document is never lost, though its text may become empty; null texts stay null.
    Rows that are equal in id and text count as one document and keep the same lines. All columns
    stay; ``n_chars``, if there, is counted anew for texts that changed. No column name clashes, as
    whole rows go along as one struct. An empty table gives an empty one.
    """
    rows = df.select(F.struct(*df.columns).alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("uid"))
    gone = dropped_lines(df, p).where("dropped").groupBy("uid").agg(F.collect_set("line_no").alias("gone"))
    joined = rows.join(gone, "uid", "left").select(
        "_row",
        F.expr("if(gone is null, _row.text, array_join(filter(split(_row.text, '\\n', -1), (x, i) -> not array_contains(gone, i)), '\\n'))").alias("_text"),
        F.col("gone").isNotNull().alias("_changed"),
    )
    cols = {"text": F.col("_text")}  # the row's own columns are read from its struct, so no name clashes
    if "n_chars" in df.columns:
        kind = df.schema["n_chars"].dataType
        cols["n_chars"] = F.when(F.col("_changed"), F.length("_text").cast(kind)).otherwise(F.col("_row.n_chars"))
    return joined.select([cols.get(c, F.col("_row")[c]).alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines dropped (and which), links, and the documents that keep them.

    Repeated rows share a uid and meet here several times over; sets of places count each line once.
    """
    docs = table(spark, sf_dir, "documents")
    found = dropped_lines(docs).groupBy("uid").agg(
        F.collect_set(F.struct("line_no", "links")).alias("places"),
        F.sort_array(F.collect_set(F.when(F.col("dropped"), F.col("line_no")))).alias("dropped_lines"),
        F.sort_array(F.collect_set(F.when(F.col("dropped"), F.col("kept_in")))).alias("kept_in"),
    )
    each = with_uid(docs, "doc_id", "text").select("uid", "doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    each = each.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    none = F.array().cast("array<int>")
    return each.join(found, "uid", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("dropped_lines").cast("long"), F.lit(0)).alias("n_dropped"),
        F.coalesce(F.expr("aggregate(places, 0L, (s, x) -> s + x.links)"), F.lit(0)).alias("n_links"),
        F.coalesce("dropped_lines", none).alias("dropped_lines"),
        F.coalesce("kept_in", none.cast("array<long>")).alias("kept_in"),
    )


QUERIES = {"op5_line_dedup": query}
ORACLES: dict[str, str] = {}
