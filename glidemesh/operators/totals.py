"""Running totals in an order, over several levels of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the order's key below which each level's blocks begin: a level has at most 2**16 blocks in one above.
LEVELS = (8, 24, 40, 56)


def running_totals(df: DataFrame, key: str, order: list[str], value: str, most: int | None = None) -> DataFrame:
    """``df`` with ``total``, the sum of ``value`` up to and with each row, by the whole number ``key`` and
    then by ``order``; with ``most`` only rows whose total is at most that.

    Sums are taken of blocks of keys, of blocks of those blocks and so on. From the top down each
    block learns what is before it from its neighbours in one block above, so a window holds at most
    2**16 blocks or the rows of 2**8 keys, whatever the table's size; blocks that begin beyond
    ``most`` go no further down. Null keys come first, null values count nothing.
    """
    block = lambda bits: F.shiftright(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), bits)
    names = [f"_b{bits}" for bits in LEVELS]
    # a row carries its lowest block alone, which tells those above
    rows = df.withColumn(names[0], block(LEVELS[0]))
    higher = [F.shiftright(names[0], bits - LEVELS[0]).alias(n) for n, bits in zip(names[1:], LEVELS[1:])]
    sums = [rows.groupBy(names[0]).agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum")).select("*", *higher)]
    for i in range(1, len(LEVELS)):
        sums.append(sums[-1].groupBy(*names[i:]).agg(F.sum("_sum").alias("_sum")))
    above = None
    for i in range(len(LEVELS) - 1, -1, -1):
        by = Window.partitionBy(*names[i + 1 :]) if names[i + 1 :] else Window.partitionBy(F.lit(0))
        inner = F.coalesce(F.sum("_sum").over(by.orderBy(names[i]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        level = sums[i] if above is None else sums[i].join(above, names[i + 1 :])
        start = inner if above is None else F.col("_before") + inner
        above = level.withColumn("_start", start).select(*names[i:], F.col("_start").alias("_before"))
        if most is not None:
            above = above.where(F.col("_before") <= most)
    last = F.sum(value).over(Window.partitionBy(names[0]).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(above.select(names[0], "_before"), names[0]).withColumn("total", F.col("_before") + F.coalesce(last, F.lit(0))).drop(names[0], "_before")
    return out if most is None else out.where(F.col("total") <= most)
