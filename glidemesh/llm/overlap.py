"""Cut long texts into overlapping chunks and splice them where both readings agree.

A chunk is read from a place that need not be a boundary, and ends in the middle of something, so
its first and last tokens may be wrong. Chunk ``i`` and chunk ``i + 1`` both cover the zone of
``2 * overlap`` characters around their border. From a boundary that both readings have, and that
is stable (what follows does not depend on what went before), they agree. By induction from the
start of the text each splice is a boundary of the whole text's reading. Where a zone has no such
place, the text is cut again with a wider overlap, and at last read whole.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import pieces

CHUNK_SCHEMA = "uid long, doc_id long, i int, n int, base long, size long, part string"


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of ``docs(uid, doc_id, text)``, dealt to tasks by chunk, so one text uses many."""

    def run(batches):
        for pdf in batches:
            rows, held = [], 0
            for uid, doc, text in zip(pdf.uid, pdf.doc_id, pdf.text):
                for i, n, base, part in pieces(text, chunk, overlap):
                    rows.append((uid, doc, i, n, base, len(text), part))
                    held += len(part)
                    if held > 4_000_000:
                        yield frame(rows)
                        rows, held = [], 0
            if rows:
                yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["uid", "doc_id", "i", "n", "base", "size", "part"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return docs.mapInPandas(run, CHUNK_SCHEMA).repartition("uid", "i")


def spliced(chunks: DataFrame, bounds: Callable[[str], list[int]], chunk: int, overlap: int, margin: int) -> DataFrame:
    """Add ``lo`` and ``hi``, the part of the text that each chunk owns, and ``ok`` for the text.

    ``bounds(part)`` gives a chunk's stable boundaries; those within ``margin`` characters of its
    cut end are not trusted.
    """

    def run(batches):
        for pdf in batches:
            heads, tails = [], []
            for i, n, base, part in zip(pdf.i, pdf.n, pdf.base, pdf.part):
                at = [base + p for p in bounds(part)]
                end = base + len(part) - margin
                heads.append([p for p in at if p < i * chunk + overlap] if i else [])
                tails.append([p for p in at if (i + 1) * chunk - overlap <= p <= end] if i < n - 1 else [])
            yield pdf.assign(head=heads, tail=tails)

    marked = chunks.mapInPandas(run, CHUNK_SCHEMA + ", head array<long>, tail array<long>")
    by = Window.partitionBy("uid").orderBy("i")
    at = marked.withColumn("splice", F.array_min(F.array_intersect("tail", F.lead("head").over(by))))
    return at.select(
        "uid", "doc_id", "i", "n", "base", "size", "part",
        F.when(F.col("i") == 0, F.lit(0)).otherwise(F.lag("splice").over(by)).cast("long").alias("lo"),
        F.when(F.col("i") == F.col("n") - 1, F.col("size")).otherwise(F.col("splice")).alias("hi"),
        F.min(F.when((F.col("i") < F.col("n") - 1) & F.col("splice").isNull(), 0).otherwise(1))
        .over(Window.partitionBy("uid")).alias("ok"),
    )


def owned_parts(
    docs: DataFrame, bounds: Callable[[str], list[int]], chunk: int, overlaps: tuple[int, ...], margin: int
) -> DataFrame:
    """Exact pieces ``(uid, doc_id, i, part)`` of ``docs(uid, doc_id, text)``.

    Texts for which an overlap fails go on to the next, wider one; the last resort is a single
    piece, the whole text. The pieces of a text, in order of ``i``, make up the text, and each
    begins and ends at boundaries of the whole text's reading.
    """
    done, todo = None, docs
    for overlap in overlaps:
        if 2 * overlap >= chunk:
            raise ValueError("an overlap must be less than half a chunk")
        marked = spliced(cut(todo, chunk, overlap), bounds, chunk, overlap, margin)
        good = marked.where("ok = 1").select(
            "uid", "doc_id", "i",
            F.expr("substring(part, cast(lo - base + 1 as int), cast(hi - lo as int))").alias("part"),
        )
        done = good if done is None else done.unionByName(good)
        # the same text again: each chunk's own share, joined in order
        own = F.expr(
            "substring(part, cast(i * {c}L - base + 1 as int), {c})".format(c=chunk)
        )
        todo = (
            marked.where("ok = 0")
            .select("uid", "doc_id", "i", own.alias("own"))
            .groupBy("uid", "doc_id")
            .agg(F.expr("array_join(transform(array_sort(collect_list(struct(i, own))), x -> x.own), '')").alias("text"))
        )
    return done.unionByName(todo.select("uid", "doc_id", F.lit(0).alias("i"), F.col("text").alias("part")))
