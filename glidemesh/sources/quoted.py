"""Records of comma-separated files whose quoted fields may hold line ends, read from split files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The inside of a quoted field, and a whole field that ends on its line; quotes count only at a field's start.
_INSIDE = r'(?:[^"]++|"")*+'
_FIELD = rf'(?>"{_INSIDE}"[^,]*+|[^",][^,]*+|(?!"))'
#: Lines that end inside quotes: begun outside, and begun inside.
_OPENS = rf'^(?:{_FIELD},)*+"{_INSIDE}$'
_STAYS = rf'^{_INSIDE}$|^{_INSIDE}"[^,]*+,(?:{_FIELD},)*+"{_INSIDE}$'


def _after(begins: Column, fixed: Column, since: Column, flips: Column) -> Column:
    """The state after lines of which the last that settles it left ``fixed`` when ``since`` of
    ``flips`` turns were done; without one it is the state at the beginning, turned so often."""
    return F.when(fixed.isNull(), (begins + flips) % 2).otherwise((fixed + flips - since) % 2)


def file_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, block, n, line)``: lines of files below folders; ``block`` orders a file's splits, ``n``
    the lines of a split. A file is UTF-8 if all its lines are, with or without a mark, else Latin-1."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(paths)
    lines = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value"
    )
    utf8 = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return lines.join(utf8, "path").select("path", "block", "n", F.regexp_replace(text, "^\\uFEFF", "").alias("line"))


def records(lines: DataFrame) -> DataFrame:
    """``(path, line_no, record)``: the lines that belong together, joined by line ends, and the number
    of the first in its file.

    Whether a line begins inside quotes depends on all lines before it. What a line does to that
    state (settle it, turn it or leave it) is told from the line alone; these effects are added up
    inside each split, then over a file's splits, a row each, so no task holds a file.
    """
    inner = Window.partitionBy("path", "block").orderBy("n")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    splits_before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opens, stays = F.regexp_like("line", F.lit(_OPENS)).cast("int"), F.regexp_like("line", F.lit(_STAYS)).cast("int")
    one = lines.withColumns({"opens": opens, "stays": stays})
    one = one.withColumns({"settles": F.when(F.col("opens") == F.col("stays"), F.col("opens")), "turns": F.when(F.col("opens") > F.col("stays"), 1).otherwise(0)})
    flips = F.coalesce(F.sum("turns").over(before), F.lit(0))
    one = one.withColumn("flips", flips)
    last = F.last(F.when(F.col("settles").isNotNull(), F.struct(F.col("settles").alias("to"), (F.col("flips") + F.col("turns")).alias("at"))), ignorenulls=True)
    one = one.withColumns({"fixed": last.over(before), "nth": F.row_number().over(inner)})

    # the state at the beginning of each split
    settled = F.max_by(F.struct(F.col("settles").alias("to"), (F.col("flips") + F.col("turns")).alias("at")), F.when(F.col("settles").isNotNull(), F.col("n")))
    split = one.groupBy("path", "block").agg(settled.alias("s"), F.sum("turns").alias("turned"), F.count("*").alias("count"))
    split = split.withColumns({"done": F.coalesce(F.sum("turned").over(splits_before), F.lit(0)), "first_no": F.coalesce(F.sum("count").over(splits_before), F.lit(0))})
    held = F.last(F.when(F.col("s.at").isNotNull(), F.struct(F.col("s.to").alias("to"), (F.col("done") + F.col("s.at")).alias("at"))), ignorenulls=True).over(splits_before)
    split = split.withColumn("held", held)
    split = split.select("path", "block", "first_no", _after(F.lit(0), F.col("held.to"), F.col("held.at"), F.col("done")).alias("begins"))

    one = one.join(split, ["path", "block"]).withColumn("inside", _after(F.col("begins"), F.col("fixed.to"), F.col("fixed.at"), F.col("flips")))
    one = one.withColumn("line_no", F.col("first_no") + F.col("nth") - 1)
    # a line that begins inside quotes belongs to the record of the last that does not, in this split or before
    starts = F.when(F.col("inside") == 0, F.col("line_no"))
    one = one.withColumn("own", F.last(starts, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    carried = one.groupBy("path", "block").agg(F.max(starts).alias("last")).withColumn("carried", F.max("last").over(splits_before)).drop("last")
    one = one.join(carried, ["path", "block"]).withColumn("of", F.coalesce("own", "carried", F.lit(0)))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return one.groupBy("path", F.col("of").alias("line_no")).agg(F.array_join(F.transform(parts, lambda x: x.line), "\n").alias("record"))


def fields(record: Column) -> Column:
    """The fields of a record: quoted ones without their quotes, doubled quotes single, what follows a
    closing quote kept. A line end at the record's end is no part of it, and quotes may be left open."""
    whole = F.regexp_replace(record, "\\r$", "")
    whole = F.when(F.regexp_like(whole, F.lit(_OPENS)), F.concat(whole, F.lit('"'))).otherwise(whole)
    each = F.regexp_extract_all(F.concat(whole, F.lit(",")), F.lit(rf'("{_INSIDE}"[^,]*+|[^,]*+),'), F.lit(1))
    inner = rf'^"({_INSIDE})"([^,]*+)$'

    def plain(x: Column) -> Column:
        quoted = F.concat(F.replace(F.regexp_extract(x, inner, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, inner, 2))
        return F.when(F.startswith(x, F.lit('"')), quoted).otherwise(x)

    return F.transform(each, plain)
