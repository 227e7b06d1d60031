"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import table


@dataclass(frozen=True)
class MixParams:
    block_bytes: int = 65_536
    period: int = 1_000  # slots of a period, more for more sources; a source's weight is a whole number of them
    bucket_rows: int = 2_000  # rows of a source that are put in order together


def default_weights(totals: DataFrame, period: int) -> DataFrame:
    """``(source, parts)``: weights as the square root of each source's bytes, in parts of a period.

    Every source gets one part, the rest go by largest remainder. Whole numbers throughout, so the
    parts add up to the period exactly. Where there are more sources than ``period``, the period is
    its least multiple of two slots a source or more, so no source is left without a part.
    """
    every = Window.partitionBy()
    root = F.floor(F.sqrt(F.col("bytes").cast("double"))).cast("long") + 1
    q = totals.select("source", root.alias("q")).withColumn("k", F.count("*").over(every))
    left = F.expr(f"if(k > {period}, (2 * k + {period - 1}) div {period} * {period}, {period}L) - k")
    q = q.withColumn("all_q", F.sum("q").over(every)).withColumn("room", left)
    q = q.select("source", "room", F.expr("room * q div all_q").alias("whole"), F.expr("room * q % all_q").alias("frac"))
    rank = F.row_number().over(Window.orderBy(F.desc("frac"), "source"))
    spare = F.col("room") - F.sum("whole").over(every)
    return q.select("source", (1 + F.col("whole") + F.when(rank <= spare, 1).otherwise(0)).alias("parts"))


def schedule(weights: DataFrame) -> DataFrame:
    """One period ``(source, nth, slot, parts, period)`` of ``weights(source, parts)``.

    Block ``i`` of a source with ``w`` of ``n`` parts is released at slot floor(i n / w) and due by
    ceil((i + 1) n / w). In every slot the released block that is due first runs (ties: the source
    that sorts first). As the weights fill the period, every block meets its deadline, so at any
    slot each source is less than one block from its share; and as all blocks of a period lie
    inside it, the next period is the same again. The table is as long as a period, whatever the
    number of rows.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("source", "parts"))).alias("s"), F.sum("parts").alias("n"))
    due = "struct(((d[i] + 1) * n + s[i].parts - 1) div s[i].parts as due, i as i)"
    ready = f"filter(transform(sequence(0, size(s) - 1), i -> if(d[i] < s[i].parts and d[i] * n div s[i].parts <= t, {due}, null)), x -> x is not null)"
    slots = one.selectExpr(
        "s", "n",
        f"""aggregate(sequence(0L, n - 1),
              struct(transform(s, x -> 0L) as d, cast(array() as array<int>) as run),
              (a, t) -> transform(array(struct(a.d as d, a.run as run)), b ->
                transform(array(array_min({ready.replace('d[i]', 'b.d[i]')}).i), k -> struct(
                  transform(b.d, (v, i) -> if(i = k, v + 1, v)) as d,
                  array_append(b.run, k) as run))[0])[0],
              a -> a.run) as run""",
    )
    each = slots.select("s", "n", F.posexplode("run").alias("slot", "k"))
    each = each.selectExpr("s[k].source as source", "s[k].parts as parts", "n as period", "cast(slot as long) as slot")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return each.withColumn("nth", nth.cast("long"))


def mix(
    df: DataFrame,
    weights: DataFrame | None = None,
    p: MixParams = MixParams(),
    size: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: bool = False,
) -> DataFrame:
    """Give every row its place ``(source, block, release, due, slot, start)`` in the mixed stream.

    A source's rows stand in the order of a hash of their id and are laid end to end; ``block`` is
    the block of ``block_bytes`` in which a row begins, ``start`` how far into it. Blocks take
    their slots from the period's schedule, shifted by whole periods, so nothing but a period is
    ever worked out in sequence. All rows are placed: when a source has run out, its later slots
    stay empty and the others go on.

    Positions within a source come from sums over buckets of a hash, about ``bucket_rows`` rows
    each, so a source with a third of all rows is no larger task than others. ``weights(source,
    parts)`` may be given; a source that it lacks, or gives less than one part, gets one part, so no
    row is lost. A null source is a source of its own, shown as null; null sizes count as 0; repeated
    rows are placed one after the other. ``size`` defaults to the UTF-8 bytes of ``text``. With
    ``keep`` the whole row goes along as ``_row``, so column names cannot clash.
    """
    size = F.octet_length("text") if size is None else size
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("source"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"),
        *([F.struct(*df.columns).alias("_row")] if keep else []),
    )
    # a multiplicative hash that any SQL engine can repeat
    h = F.expr("pmod(coalesce(doc_id, -1) % 1000000007 * 7919 + 104729, 1000003)")
    buckets = max(1, min(1 << 16, df.count() // p.bucket_rows))
    rows = rows.withColumn("h", h).withColumn("bucket", F.expr(f"h * {buckets} div 1000003"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("bytes").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offset = totals.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    if weights is None:
        weights = default_weights(totals.groupBy("source").agg(F.sum("bytes").alias("bytes")), p.period)
    else:
        weights = weights.select(
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("source"),
            F.col("parts").cast("long").alias("parts"),
        )
        weights = totals.select("source").distinct().join(weights, "source", "full")
        weights = weights.select("source", F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)).cast("long").alias("parts"))
    plan = schedule(weights)
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "bytes").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("offset") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    placed = rows.join(offset, ["source", "bucket"]).withColumn("at", at)
    placed = placed.withColumn("block", F.expr(f"at div {p.block_bytes}")).withColumn("start", F.expr(f"at % {p.block_bytes}"))
    parts = plan.select("source", "parts", "period").distinct()
    placed = placed.join(parts, "source").withColumn("nth", F.col("block") % F.col("parts"))
    out = placed.join(plan.select("source", "nth", F.col("slot").alias("in_period")), ["source", "nth"])
    return out.select(
        "doc_id",
        F.expr("if(source = 'n', null, substring(source, 2))").alias("source"),
        "block",
        F.expr("block * period div parts").alias("release"),
        F.expr("((block + 1) * period + parts - 1) div parts").alias("due"),
        F.expr("block div parts * period + in_period").alias("slot"),
        "start",
        *(["_row"] if keep else []),
    )


def mixed_order(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The documents in the mixed order, with the columns they had.

    Written as files, the rows follow the schedule from file to file and within each.
    """
    return in_order(mix(docs, p=p, keep=True)).select("_row.*")


def in_order(placed: DataFrame) -> DataFrame:
    """Rows with a place ``(slot, start)``, dealt and sorted by it."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "slot", "start").sortWithinPartitions("slot", "start", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE r AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source,
         coalesce(strlen(text), 0) AS bytes,
         (coalesce(doc_id, -1) % 1000000007 * 7919 + 104729) % 1000003 AS h
  FROM documents),
q AS (SELECT source, CAST(floor(sqrt(CAST(sum(bytes) AS DOUBLE))) AS BIGINT) + 1 AS q FROM r GROUP BY source),
q2 AS (SELECT source, (1000 - count(*) OVER ()) * q // CAST(sum(q) OVER () AS BIGINT) AS whole,
              (1000 - count(*) OVER ()) * q % CAST(sum(q) OVER () AS BIGINT) AS frac, 1000 - count(*) OVER () AS room FROM q),
w AS (SELECT source, 1 + whole + CASE WHEN row_number() OVER (ORDER BY frac DESC, source) <= room - CAST(sum(whole) OVER () AS BIGINT)
                                      THEN 1 ELSE 0 END AS parts FROM q2),
l AS (SELECT list(source ORDER BY source) AS s, list(parts ORDER BY source) AS p FROM w),
e AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(l.p, lambda x: CAST(0 AS BIGINT)) AS d, CAST(NULL AS BIGINT) AS k FROM l
  UNION ALL
  SELECT u.t + 1, list_transform(range(1, len(u.d) + 1), lambda i: u.d[i] + CASE WHEN i = u.k THEN 1 ELSE 0 END), u.k
  FROM (SELECT e.t, e.d, list_min(list_transform(list_filter(range(1, len(e.d) + 1),
               lambda i: e.d[i] < l.p[i] AND e.d[i] * 1000 // l.p[i] <= e.t + 1),
               lambda i: {'due': ((e.d[i] + 1) * 1000 + l.p[i] - 1) // l.p[i], 'i': i})).i AS k
        FROM e, l WHERE e.t < 999) u),
plan AS (SELECT l.s[e.k] AS source, l.p[e.k] AS parts, e.t AS slot,
                row_number() OVER (PARTITION BY e.k ORDER BY e.t) - 1 AS nth FROM e, l WHERE e.k IS NOT NULL),
a AS (SELECT doc_id, source, CAST(coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, bytes
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM r),
b AS (SELECT a.*, pos // 65536 AS block, w.parts FROM a JOIN w USING (source))
SELECT b.doc_id, CASE WHEN b.source = 'n' THEN NULL ELSE substr(b.source, 2) END AS source, b.block,
       b.block * 1000 // b.parts AS release, ((b.block + 1) * 1000 + b.parts - 1) // b.parts AS due,
       b.block // b.parts * 1000 + plan.slot AS slot, b.pos % 65536 AS start
FROM b JOIN plan ON plan.source = b.source AND plan.nth = b.block % b.parts
"""

QUERIES = {"op4_pfair_mix": query}
ORACLES = {"op4_pfair_mix": SQL}
