"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see, under ``spark.checkpoint.dir``."""
    return f"{_base(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def _base(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a session on one machine may name none: a
    temporary folder serves it. On a cluster that would be another folder on every machine, so it
    is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def ensure_checkpoint(spark: SparkSession) -> None:
    """Let ``checkpoint()`` work: the cluster's folder if it names one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_base(spark))


def saved(df: DataFrame, folder: str, compression: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it back, which cuts its lineage."""
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand Python workers at most ``rows`` rows at once, so that a batch of long texts stays small
    on both sides of the pipe. It is a setting of the session, read when a plan runs; a smaller one
    is left as it is. ``batch_setting`` puts back what was there before."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


@contextmanager
def batch_setting(spark: SparkSession) -> Iterator[None]:
    """On leaving, the session's batch size is what it was on entering."""
    before = spark.conf.get(BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, component the smallest id.

    Each round hangs every node's larger neighbours and the node itself on its smallest neighbour
    (large star), then its smaller neighbours too (small star). Edges stay about as many as they
    were, no component is gathered in one place, and the rounds grow with the logarithm of the
    longest chain. Rounds are cut by ``checkpoint()``.
    """
    ensure_checkpoint(edges.sparkSession)
    cur = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cur = cur.checkpoint()
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: neighbours above u move to the smallest of u's neighbourhood
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low2, "b").select("a", "b", "m")
        nxt = (
            small.select(F.col("m").alias("a"), "b")
            .union(small.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
            .distinct()
            .checkpoint()
        )
        row = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == before:
            cur = nxt
            break
        before, cur = (row[0], row[1]), nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "id").union(
        cur.select("a").distinct().select("a", F.col("a").alias("component"))
    ).toDF("id", "component").groupBy("id").agg(F.min("component").alias("component"))


def pieces(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int, str]]:
    """(index, number, first position, text) of chunks that reach ``overlap`` into both neighbours."""
    n = max(1, -(-len(text) // chunk))
    for i in range(n):
        base = max(0, i * chunk - overlap)
        yield i, n, base, text[base : (i + 1) * chunk + overlap if i < n - 1 else len(text)]
