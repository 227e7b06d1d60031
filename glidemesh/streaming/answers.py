"""Position fixes as a stream, and their answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_fixes(spark: SparkSession, path: str, schema: StructType, stream: bool = True) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder, or of those that are there now."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).parquet(path)


def stream_answers(fixes: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Answers to every batch of fixes that is there, written below ``out``.

    Ranking needs windows over a fix's sites, which streams have not, so each batch goes through the
    batch plan. A batch has a folder of its own that is overwritten: one that is run again after a
    failure leaves its answers once.
    """

    def run(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fixes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_answers(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")
